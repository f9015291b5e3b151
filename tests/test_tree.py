"""Groups of bounded size, neighbour pairs and the distributed tree walk against sums over all pairs."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshweave.operators import octree, tree
from meshweave.operators.mesh import Mesh

BOX = 50.0


def clustered(dim, seed=4):
    """Points of very different density: a field, a clump, a clump in the clump, points at one place and at the box's edge."""
    rng = np.random.default_rng(seed)
    parts = [rng.uniform(0, BOX, (250, dim)), 49.5 + rng.normal(0, 1.0, (400, dim)), 20 + rng.normal(0, 1e-2, (300, dim)), np.full((40, dim), 7.25), np.full((1, dim), BOX)]
    return np.concatenate(parts)


def frame_of(spark, x):
    names = ["x", "y", "z"][: x.shape[1]]
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, " + ", ".join(f"{n} double" for n in names)).repartition(5)


def brute(x, mesh, alpha, reach):
    d = np.mod(x[:, None] - x[None] + mesh.box / 2, mesh.box) - mesh.box / 2
    r = np.sqrt((d**2).sum(axis=2))
    near = (r > 0) & (r < reach)
    r[~near] = 1.0
    erfc = np.vectorize(math.erfc, otypes=[float])
    shape = np.exp(-(r**2) / (2 * alpha**2)) if mesh.dim == 2 else erfc(r / (math.sqrt(2) * alpha)) + math.sqrt(2 / math.pi) * r / alpha * np.exp(-(r**2) / (2 * alpha**2))
    unit = -(mesh.box**mesh.dim) / (len(x) * (4 * math.pi if mesh.dim == 3 else 2 * math.pi))
    return (d * (np.where(near, shape, 0) / r**mesh.dim)[:, :, None]).sum(axis=1) * unit


def forces(df, dim):
    return df.toPandas().sort_values("id")[[f"a{x}" for x in "xyz"[:dim]]].to_numpy()


@pytest.mark.parametrize(("dim", "alpha"), [(3, 1.5), (2, 3.0), (3, 30.0)])
def test_walk_on_clustered_points(spark, dim, alpha):
    x, mesh = clustered(dim), Mesh(dim, 8, BOX)
    want = brute(np.mod(x, BOX), mesh, alpha, min(6 * alpha, BOX / 2))
    scale = np.sqrt((want**2).mean())
    df = frame_of(spark, x)
    exact = forces(tree.tree_force(df, mesh, alpha, 0.0, leaf=8, most=64), dim)
    assert np.abs(exact - want).max() < 1e-9 * np.abs(want).max()
    opened = forces(tree.tree_force(df, mesh, alpha, 0.4, leaf=8, most=64), dim)
    assert np.sqrt(((opened - want) ** 2).mean()) < 2e-3 * scale
    assert np.abs(opened - exact).max() > 0


def test_groups_are_bounded_and_cover_all(spark):
    x, mesh = clustered(3), Mesh(3, 8, BOX)
    groups, packed = octree.grouped(octree_input(spark, x), mesh, 8, 32)
    rows = packed.withColumn("ids", F.col("points.id")).select("level", "prefix", "part", "n", "ids").collect()
    assert sorted(i for r in rows for i in r["ids"]) == list(range(len(x)))
    whole = [r for r in rows if r["level"] < 8]
    assert all(r["n"] <= 32 for r in whole) and len({r["level"] for r in rows}) > 2
    assert max(r["part"] for r in rows) >= 1 and max(r["n"] for r in rows) < 64  # equal places are dealt into parts
    assert groups.count() >= len(rows)


def octree_input(spark, x):
    return frame_of(spark, x)


@pytest.mark.parametrize(("dim", "radius"), [(3, 1.0), (3, 22.0), (2, 0.3)])
def test_pairs_on_clustered_points(spark, dim, radius):
    x, mesh = clustered(dim)[::3], Mesh(dim, 8, BOX)
    got = {(r["a"], r["b"]): r for r in tree.neighbour_pairs(frame_of(spark, x), mesh, radius, most=16).collect()}
    at = np.mod(x, BOX)
    d = np.mod(at[:, None] - at[None] + BOX / 2, BOX) - BOX / 2
    r = np.sqrt((d**2).sum(axis=2))
    a, b = np.nonzero((r < radius) & (np.arange(len(x))[:, None] < np.arange(len(x))[None]))
    assert set(got) == set(zip(a.tolist(), b.tolist(), strict=True))
    for i, j in zip(a.tolist()[:500], b.tolist(), strict=False):
        row = got[i, j]
        assert abs(row["r"] - r[i, j]) < 1e-12 and np.allclose([row[f"d{c}"] for c in "xyz"[:dim]], d[i, j])


def test_join_of_cells_is_never_broadcast(spark, tmp_path):
    rng = np.random.default_rng(9)
    x, mesh = rng.uniform(0, BOX, (500, 3)), Mesh(3, 8, BOX)
    frame_of(spark, x).write.parquet(f"file://{tmp_path}/points")
    pairs = tree.neighbour_pairs(spark.read.parquet(f"file://{tmp_path}/points"), mesh, 4.0)
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()
    d = np.mod(x[:, None] - x[None] + BOX / 2, BOX) - BOX / 2
    r = np.sqrt((d**2).sum(axis=2))
    a, b = np.nonzero((r < 4.0) & (np.arange(len(x))[:, None] < np.arange(len(x))[None]))
    got = {(row["a"], row["b"]): [row[c] for c in ("r", "dx", "dy", "dz")] for row in pairs.collect()}
    assert got.keys() == set(zip(a.tolist(), b.tolist(), strict=True)) and len(got) == pairs.count()
    assert all(np.allclose(got[i, j], [r[i, j], *d[i, j]]) for i, j in zip(a.tolist(), b.tolist(), strict=True))


def test_empty_single_and_null_places(spark):
    mesh = Mesh(3, 8, BOX)
    none = spark.createDataFrame([], "id long, x double, y double, z double")
    assert tree.tree_force(none, mesh, 2.0).collect() == [] and tree.neighbour_pairs(none, mesh, 2.0).collect() == []
    few = spark.createDataFrame([(1, 1.0, 1.0, 1.0), (2, None, 1.0, 1.0)], "id long, x double, y double, z double")
    assert [tuple(r) for r in tree.tree_force(few, mesh, 2.0).collect()] == [(1, 0.0, 0.0, 0.0)]


@pytest.mark.parametrize("dim", [2, 3])
def test_pair_sums_by_table(dim):
    rng, mesh = np.random.default_rng(3), Mesh(dim, 8, BOX)
    at = np.concatenate([rng.uniform(24, 26, (20, dim)), rng.normal(25, 1e-6, (5, dim)), [[25.0] * dim] * 2])
    at[:3] += rng.uniform(0, 1, (3, dim)) / 3  # the middle of all is no round number
    source = np.concatenate([at, rng.uniform(0, BOX, (4000, dim)), [[25.0] * (dim - 1) + [34.0]]])
    mass = np.concatenate([np.ones(len(at)), rng.integers(1, 9, 4001)]).astype(float)
    for alpha, reach in ((1.5, 9.0), (20.0, BOX / 2)):
        d = np.mod(at[:, None] - source[None] + BOX / 2, BOX) - BOX / 2
        r = np.sqrt((d**2).sum(axis=2))
        near = (r > 0) & (r < reach)
        weight = np.where(near, mass * tree._shape(r, alpha, dim) / np.where(near, r, 1.0) ** dim, 0)
        size = (np.abs(d) * weight[:, :, None]).sum(axis=1)
        assert (np.abs(tree.pulled(at, source, mass, mesh, alpha, reach) - (d * weight[:, :, None]).sum(axis=1)) < 1e-9 * size + 1e-12).all()
    few, many = rng.uniform(24, 26, (32, dim)), rng.uniform(15, 35, (40_000, dim))
    took = []
    for sums in (tree.pulled, by_differences):
        sums(few, many[:100], np.ones(100), mesh, 1.5, 9.0)
        at_ = time.process_time()
        sums(few, many, np.ones(len(many)), mesh, 1.5, 9.0)
        took.append(time.process_time() - at_)
    assert took[0] < took[1] / 2


def by_differences(at, source, mass, mesh, alpha, reach):
    """The sums without a table: each pair's image, root and error function."""
    d = np.mod(at[:, None, :] - source[None, :, :] + mesh.box / 2, mesh.box) - mesh.box / 2
    r = np.sqrt((d * d).sum(axis=2))
    i, j = np.nonzero((r > 0) & (r < reach))
    weight = mass[j] * tree._shape(r[i, j], alpha, mesh.dim) / r[i, j] ** mesh.dim
    return np.stack([np.bincount(i, weight * d[i, j, k], len(at)) for k in range(mesh.dim)], axis=1)


def test_far_nodes_keep_the_force(spark):
    """One mass a node misses a thousandth of the typical force where nodes hold many particles."""
    rng, mesh = np.random.default_rng(6), Mesh(3, 8, BOX)
    df = frame_of(spark, np.concatenate([rng.uniform(4, 19, (3500, 3)), 10 + rng.normal(0, 1.5, (500, 3))]))
    exact, opened = (forces(tree.tree_force(df, mesh, 2.5, theta), 3) for theta in (0.0, 0.5))
    off = np.abs(opened - exact).max() / np.sqrt((exact**2).sum(axis=1).mean())
    assert 1e-9 < off < 3e-4


def test_what_is_sent_grows_with_the_particles(spark, monkeypatch):
    """Not with their square: the groups grow, and what a group is sent comes in rows of bounded size."""
    rng, mesh, most = np.random.default_rng(12), Mesh(3, 8, BOX), []
    monkeypatch.setattr(tree, "grouped", lambda particles, mesh, bits, n: most.append(n) or octree.grouped(particles, mesh, bits, 2048))
    for count in (10**7, 10**8):
        df = frame_of(spark, rng.uniform(0, BOX, (20, 3)))
        monkeypatch.setattr(df, "count", lambda n=count: n, raising=False)
        tree.tree_force(df, mesh, 1.0, 0.0)
    assert most[1] >= 1.5 * most[0] >= 10**7 // 50
    assert [x.stop - x.start for x in tree.parted(np.full(100, 32), 320)] == [10] * 10
    assert sum(x.stop - x.start for x in tree.parted(np.array([5000, 1, 5000]), 10)) == 3


def test_groups_of_pairs_grow_with_the_particles(spark, monkeypatch):
    """Small groups would be sent to hundreds of others; pairs are the same in groups larger than a run."""
    rng, mesh, most = np.random.default_rng(13), Mesh(3, 8, BOX), []
    x = rng.uniform(0, BOX, (300, 3))
    df = frame_of(spark, x)
    monkeypatch.setattr(df, "count", lambda: 10**8, raising=False)
    monkeypatch.setattr(tree, "grouped", lambda particles, mesh, bits, n: most.append(n) or octree.grouped(particles, mesh, bits, 100))
    got = [(r["a"], r["b"]) for r in tree.neighbour_pairs(df, mesh, 20.0, most=7).collect()]
    d = np.mod(x[:, None] - x[None] + BOX / 2, BOX) - BOX / 2
    a, b = np.nonzero((np.sqrt((d**2).sum(axis=2)) < 20.0) & (np.arange(300)[:, None] < np.arange(300)[None]))
    assert most == [1 << 17] and len(got) == len(set(got)) and set(got) == set(zip(a.tolist(), b.tolist(), strict=True))


def test_masses_of_a_node_keep_its_moments():
    rng = np.random.default_rng(8)
    at = np.concatenate([rng.uniform(3, 4, (100, 3)), rng.normal(3.5, 0.01, (50, 3))])
    for n in (2, 4):
        got = tree.gathered(at, n)
        for power in np.ndindex(n, n, n):
            assert np.isclose((got[:, 0] * (got[:, 1:] ** power).prod(axis=1)).sum(), (at**power).prod(axis=1).sum(), rtol=1e-12)
    flat = tree.gathered(np.array([[1.0, 2.0], [1.0, 3.0], [1.0, 2.5]]), 3)
    assert (flat[:, 1] == 1).all() and np.isclose(flat[:, 0].sum(), 3) and np.isclose((flat[:, 0] * flat[:, 2]).sum(), 7.5)


def test_error_function():
    at = np.linspace(0, 8.5, 5001)
    assert np.abs(tree.erfc(at) - np.array([math.erfc(v) for v in at])).max() < 1e-12
