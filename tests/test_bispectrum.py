"""The bispectrum by sums over closed triangles against the transforms and against plain loops."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshweave.operators import statistics
from meshweave.operators.mesh import Mesh, grid


@pytest.mark.parametrize(("mesh", "bins"), [(Mesh(2, 12, 30.0), 3), (Mesh(3, 10, 30.0), 2), (Mesh(2, 16, 5.0), 5)])
def test_direct_equals_transforms(spark, mesh, bins):
    field = grid(spark, mesh).select(*mesh.cells, (F.sin(F.col("id") * 1.9) + F.pow(F.cos(F.col("id") * 0.7), 3)).alias("v")).checkpoint()
    fast = {tuple(r)[:3]: r for r in statistics.bispectrum(field, mesh, bins).collect()}
    slow = {tuple(r)[:3]: r for r in statistics.bispectrum(field, mesh, bins, direct=True).collect()}
    assert set(fast) == set(slow)
    scale = max(abs(r["b"]) for r in fast.values() if r["b"] is not None)
    for key, r in fast.items():
        assert slow[key]["triangles"] == r["triangles"] and [slow[key][f"k{n}"] for n in (1, 2, 3)] == [r[f"k{n}"] for n in (1, 2, 3)]
        if r["triangles"]:
            assert abs(slow[key]["b"] - r["b"]) < 1e-9 * scale
    only = statistics.bispectrum(field, mesh, bins, equilateral=True, only_b=True, direct=True)
    assert only.columns == ["b1", "b2", "b3", "b"] and {tuple(r)[:3] for r in only.collect()} == {(n, n, n) for n in range(bins)}
    assert statistics.bispectrum(field, mesh, bins, only_b=True).columns == ["b1", "b2", "b3", "b"]


def test_against_loops(spark):
    mesh, bins = Mesh(2, 8, 10.0), 2
    rng = np.random.default_rng(5)
    v = rng.normal(size=(8, 8))
    field = spark.createDataFrame([(int(i), int(j), float(v[i, j])) for i in range(8) for j in range(8)], "ix int, iy int, v double")
    f, edges = np.fft.fft2(v), statistics.bispectrum_edges(mesh, bins)
    sign = lambda j: j if j < 4 else j - 8
    shells = {}
    for i, j in itertools.product(range(8), repeat=2):
        size = np.hypot(sign(i), sign(j)) * mesh.fundamental
        for s in range(bins):
            if edges[s] <= size < edges[s + 1]:
                shells.setdefault(s, []).append((sign(i), sign(j)))
    for r in statistics.bispectrum(field, mesh, bins, direct=True).collect():
        total, count = 0.0, 0
        for a, b in itertools.product(shells[r["b1"]], shells[r["b2"]]):
            c = (-a[0] - b[0], -a[1] - b[1])
            if c in shells[r["b3"]]:
                total, count = total + (f[a] * f[b] * f[c]).real, count + 1
        assert r["triangles"] == count
        if count:
            assert np.isclose(r["b"], total / count * 10.0**4 / 64**3)


def test_blocks_meet_all_pairs(spark):
    mesh = Mesh(2, 12, 30.0)
    field = grid(spark, mesh).select(*mesh.cells, F.sin("id").alias("v"))
    edges = statistics.bispectrum_edges(mesh, 2)
    a, b = (sorted((r["b1"], r["b2"], r["b3"], r["triangles"], round(r["b"], 9)) for r in statistics.closed_triangles(field, mesh, edges, block).collect()) for block in (5, 5000))
    assert a == b
