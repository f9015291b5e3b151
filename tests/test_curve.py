"""Box queries on the space-filling curve against plain filters, and the files and rows that they leave out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshweave.operators.mesh import Mesh
from meshweave.sources import curve


def stored(spark, tmp_path, dim, n=4000):
    mesh, path = Mesh(dim, 8, 10.0), f"file://{tmp_path}/curve"
    rng = np.random.default_rng(dim)
    x = np.concatenate([rng.uniform(-2, 13, (n, dim)), np.zeros((5, dim)), np.full((5, dim), 10.0)])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)] + [(-1, *[None] * dim)], "id long, " + ", ".join(f"{c} double" for c in "xyz"[:dim]))
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", str(16 << 10))
    try:
        curve.write_sorted(df, mesh, path, ranges=8)
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
    return mesh, path, np.mod(x, 10.0)


def inside(x, ranges):
    keep = np.ones(len(x), bool)
    for a, r in enumerate(ranges):
        if r is not None and r[1] - r[0] < 10:
            lo, hi = r[0] % 10, r[1] % 10
            keep &= (x[:, a] >= lo) & (x[:, a] < hi) if lo <= hi else (x[:, a] >= lo) | (x[:, a] < hi)
    return set(np.flatnonzero(keep).tolist())


def scanned(df):
    """Files and rows that the scan reads, by its metrics."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    while node.children().size():
        node = node.children().apply(0)
    get = lambda name: node.metrics().get(name).get().value()
    return get("numFiles"), get("numOutputRows")


@pytest.mark.parametrize("dim", [2, 3])
def test_boxes(spark, tmp_path, dim):
    mesh, path, x = stored(spark, tmp_path, dim)
    boxes = [[(1.0, 2.5), None], [(9.0, 11.0), (-1.0, 0.5)], [(3.3, 3.4), (7.1, 7.9)], [(0.0, 10.0), (2.0, 14.0)], [None, None], [(4.0, 4.0), None]]
    all_files, all_rows = scanned(spark.read.parquet(path))
    for box in boxes:
        box = [*box, None][:dim] if dim == 3 else box
        got = curve.read_box(spark, path, mesh, box)
        want = set() if box[0] == (4.0, 4.0) else inside(x, box)
        assert {r["id"] for r in got.collect()} == want
        assert set(got.columns) == {"id", "morton", *mesh.places}
    files, rows = scanned(curve.read_box(spark, path, mesh, [(3.3, 3.4), (7.1, 7.9), (1.0, 1.5)][:dim]))
    assert files <= all_files / (8 if dim == 3 else 4) and rows <= all_rows / 8, (files, rows)
    files, rows = scanned(curve.read_box(spark, path, mesh, [(1.0, 2.0), *[None] * (dim - 1)]))
    assert files <= all_files / 2 and rows <= all_rows / 2


def test_slices_of_cells(spark, tmp_path):
    mesh, path, x = stored(spark, tmp_path, 3)
    got = curve.read_slice(spark, path, mesh, (0, (2, 5)), margin=0.5)
    assert {r["id"] for r in got.collect()} == inside(x, [(-0.5, 1.75), (2.0, 6.75), None])


def test_intervals_are_few_and_cover():
    mesh = Mesh(3, 8, 10.0)
    box = [curve.pieces(9.0, 11.0, 10.0), curve.pieces(2.0, 3.7, 10.0), [(0.0, 10.0)]]
    for most in (1, 8, 64, 500):
        found = curve.intervals(mesh, box, most)
        assert 1 <= len(found) <= max(most + 8, 8) and all(a[1] + 1 < b[0] for a, b in zip(found, found[1:], strict=False))
    wide = [sum(hi - lo + 1 for lo, hi in curve.intervals(mesh, box, most)) for most in (1, 8, 64, 500)]
    assert wide == sorted(wide, reverse=True) and wide[0] == 1 << 36 and wide[-1] < 0.1 * wide[0]
