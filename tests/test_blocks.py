"""Deposit and gather by blocks: equal to the way by rows, and what is exchanged."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshweave.operators import blocks, particles
from meshweave.operators.mesh import Mesh, grid

MESHES = [Mesh(3, 40, 10.0), Mesh(2, 100, 10.0), Mesh(3, 64, 10.0)]


def points(spark, mesh, n=700):
    """Some anywhere, also outside the box and on its edges, half of them in one block, one without a place."""
    rng = np.random.default_rng(mesh.n)
    x = np.concatenate([rng.uniform(-3, 14, (n, mesh.dim)), rng.uniform(1, 1.5, (n, mesh.dim)), np.full((1, mesh.dim), 10.0), np.zeros((1, mesh.dim)), rng.integers(0, mesh.n, (40, mesh.dim)) * (10.0 / mesh.n)])
    rows = [(i, *map(float, p), float(i % 7) if i % 11 else None) for i, p in enumerate(x)] + [(-1, *[None] * mesh.dim, 1.0)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in "xyz"[: mesh.dim]) + ", m double").repartition(5)


def both(monkeypatch, call):
    """The result by blocks and by rows."""
    out = []
    for most in (0, 1 << 40):
        monkeypatch.setattr(particles, "BROADCAST_CELLS", most)
        out.append(call().toPandas())
    return out


@pytest.mark.parametrize("mesh", MESHES)
@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_deposit(spark, monkeypatch, mesh, order):
    df = points(spark, mesh)
    got, want = (p.groupby(mesh.cells).sum().sort_index() for p in both(monkeypatch, lambda: particles.deposit(df, mesh, order, {"v": F.lit(1.0), "m": F.col("m")}, complete=False).where("abs(v) + abs(coalesce(m, 0)) > 1e-13")))
    got, want = got[got.v.abs() > 1e-12], want[want.v.abs() > 1e-12]
    assert got.index.equals(want.index) and np.abs(got.to_numpy() - want.to_numpy()).max() < 1e-11


@pytest.mark.parametrize("mesh", MESHES[:2])
@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_gather(spark, monkeypatch, mesh, order):
    df = points(spark, mesh)
    field = grid(spark, mesh).select(*mesh.cells, F.sin("id").alias("a"), F.cos(F.col("id") * 0.3).alias("b"))
    monkeypatch.setattr(blocks, "MOST", 64)  # the crowded block is dealt into parts
    got, want = (p.set_index("id").sort_index() for p in both(monkeypatch, lambda: particles.gather(field, df, mesh, order, ("a", "b"), gradient=True)))
    assert got.index.equals(want.index) and np.abs(got[want.columns].to_numpy() - want.to_numpy()).max() < 1e-9
    # absent cells are zero
    some = particles.gather(field.where("ix > 3"), df, mesh, order, ("a",)).toPandas().set_index("id").sort_index()
    monkeypatch.setattr(particles, "BROADCAST_CELLS", 0)
    again = particles.gather(field.where("ix > 3"), df, mesh, order, ("a",)).toPandas().set_index("id").sort_index()
    assert np.abs(again.a.reindex(some.index) - some.a).max() < 1e-9


def test_no_stencil_is_exchanged(spark):
    """At 128 cells an axis: what stages write is at most particles and the cells of each task's blocks, once each."""
    mesh, n = Mesh(3, 128, 10.0), 20000
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.uniform(0, 10, (n, 3)) * [1, 0.2, 0.2])], "id long, x double, y double, z double").checkpoint()
    store = spark.sparkContext._jsc.sc().statusStore()
    from pyspark import SparkContext

    none = SparkContext._gateway.new_array(SparkContext._gateway.jvm.double, 0)

    def stages():
        found = store.stageList(None, False, False, none, None)
        return [found.apply(i) for i in range(found.size())]

    before = {s.stageId() for s in stages()}
    out = particles.deposit(df, mesh, 4, complete=False).checkpoint()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10000)
    written = sum(s.shuffleWriteRecords() for s in stages() if s.stageId() not in before)
    assert written <= n + 1.5 * out.count() < 64 * n / 4
    assert abs(out.agg(F.sum("v")).first()[0] - n) < 1e-6


def test_empty(spark):
    mesh = Mesh(3, 64, 10.0)
    none = spark.createDataFrame([], "id long, x double, y double, z double")
    assert particles.deposit(none, mesh, 2, complete=False).collect() == []
    assert particles.gather(grid(spark, mesh).select(*mesh.cells, F.lit(1.0).alias("v")), none, mesh).collect() == []
