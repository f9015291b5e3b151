"""Transforms by planes and columns, and of real fields by halves, against numpy; what they exchange."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshweave.operators import fourier as X
from meshweave.operators import statistics
from meshweave.operators.mesh import Mesh, grid
from meshweave.plans import nbody

MESHES = [Mesh(3, 34, 10.0), Mesh(2, 190, 10.0), Mesh(1, 50, 10.0), Mesh(3, 8, 10.0), Mesh(2, 6, 1.0)]


def filled(df, names, value, shape):
    pdf, out = df.toPandas(), np.zeros(shape)
    assert not pdf.duplicated(names).any()
    out[tuple(pdf[c].to_numpy() for c in names)] = pdf[value].to_numpy()
    return out


def fields(spark, mesh, sparse):
    """Two fields told from the cell's number; sparse ones lack most of their cells and whole planes."""
    df = grid(spark, mesh).select(*mesh.cells, F.sin(F.col("id") * 1.7).alias("a"), F.cos(F.col("id") * F.col("id") * 0.37).alias("b"))
    return df.where(f"ix < 3 AND pmod(hash({mesh.cells[-1]}), 5) < 2") if sparse else df


@pytest.mark.parametrize("mesh", MESHES)
@pytest.mark.parametrize("sparse", [False, True])
def test_slabs(spark, mesh, sparse):
    df, shape = fields(spark, mesh, sparse).checkpoint(), (mesh.n,) * mesh.dim
    a, b = (filled(df, mesh.cells, c, shape) for c in "ab")
    pairs = (("a", "ia"), ("b", "ib"))
    # complex, both ways, two fields in one pass
    whole = X.transform(df.select(*mesh.cells, "a", F.col("b").alias("ia"), "b", F.lit(0.5).alias("ib")), mesh, pairs, method="slab").checkpoint()
    there = filled(df.withColumn("one", F.lit(0.5)), mesh.cells, "one", shape)
    for field, (re, im) in ((a + 1j * b, pairs[0]), (b + 1j * there, pairs[1])):
        want = np.fft.fftn(field)
        assert np.abs(filled(whole, mesh.modes, re, shape) + 1j * filled(whole, mesh.modes, im, shape) - want).max() < 1e-9
    back = X.transform(whole, mesh, pairs, inverse=True, method="slab").checkpoint()
    assert np.abs(filled(back, mesh.cells, "a", shape) - a).max() < 1e-11 and np.abs(filled(back, mesh.cells, "ib", shape) - there).max() < 1e-11
    # real, by halves
    half_shape = (*shape[:-1], mesh.n // 2 + 1)
    half = X.real_forward(df, mesh, pairs, method="slab").checkpoint()
    for field, (re, im) in ((a, pairs[0]), (b, pairs[1])):
        want = np.fft.rfftn(field)
        assert np.abs(filled(half, mesh.modes, re, half_shape) + 1j * filled(half, mesh.modes, im, half_shape) - want).max() < 1e-9
    assert half.count() == np.prod(half_shape)
    real = X.real_backward(half, mesh, pairs, None, "slab").checkpoint()
    assert set(real.columns) == {*mesh.cells, "a", "b"}
    assert np.abs(filled(real, mesh.cells, "a", shape) - a).max() < 1e-11 and np.abs(filled(real, mesh.cells, "b", shape) - b).max() < 1e-11
    if mesh.size <= 4096:
        one = X.real_backward(X.real_forward(df, mesh, value="a", method="sql"), mesh, method="sql")
        assert np.abs(filled(one, mesh.cells, "v", shape) - a).max() < 1e-11


def exchanged(spark, df):
    """Bytes that the stages of one job write for others to read."""
    store = spark.sparkContext._jsc.sc().statusStore()
    before = {s.stageId() for s in stages(store)}
    df.write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10000)
    return sum(s.shuffleWriteBytes() for s in stages(store) if s.stageId() not in before)


def stages(store):
    found = store.stageList(None, False, False, spark_array(store), None)
    return [found.apply(i) for i in range(found.size())]


def spark_array(store):
    from pyspark import SparkContext

    gateway = SparkContext._gateway
    return gateway.new_array(gateway.jvm.double, 0)


def test_real_transforms_exchange_half(spark):
    mesh = Mesh(3, 64, 100.0)
    df = fields(spark, mesh, False).select(*mesh.cells, F.col("a").alias("v")).checkpoint()
    full = X.transform(df.select(*mesh.cells, F.col("v").alias("re"), F.lit(0.0).alias("im")), mesh, method="slab")
    half = X.real_forward(df, mesh, method="slab")
    spectrum, halves = full.checkpoint(), half.checkpoint()
    there = exchanged(spark, half) / exchanged(spark, full)
    back = exchanged(spark, X.real_backward(halves, mesh, method="slab")) / exchanged(spark, X.transform(spectrum, mesh, inverse=True, method="slab"))
    assert there < 0.8 and back < 0.55, (there, back)  # on the way there the cells themselves are exchanged first, as rows
    assert max(r["n"] for r in half.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()) < halves.count()


def test_operators_on_a_larger_mesh(spark):
    """Operators that pass halves, against numpy where planes and columns are many groups."""
    mesh = Mesh(3, 34, 34.0)
    df = fields(spark, mesh, False).select(*mesh.cells, F.col("a").alias("v")).checkpoint()
    a, shape = filled(df, mesh.cells, "v", (34,) * 3), (34,) * 3
    k = np.fft.fftfreq(34) * 2 * np.pi
    square = k[:, None, None] ** 2 + k[None, :, None] ** 2 + k[None, None, :] ** 2
    spectrum = np.fft.fftn(a)
    spectrum[0, 0, 0] = 0
    phi = np.fft.ifftn(-spectrum / np.where(square == 0, 1, square)).real
    assert np.abs(filled(X.potential(df, mesh), mesh.cells, "v", shape) - phi).max() < 1e-9
    ky = k.copy()
    ky[17] = 0
    slope = np.fft.ifftn(1j * ky[None, :, None] * np.fft.fftn(a)).real
    assert np.abs(filled(X.derivative(df, mesh, 1), mesh.cells, "v", shape) - slope).max() < 1e-9
    pk = statistics.power_spectrum(df, mesh, (0.1, 1.0, 2.0)).toPandas().sort_values("bin")
    size, power = np.sqrt(square), np.abs(np.fft.fftn(a)) ** 2 * 34.0**3 / mesh.size**2
    for n, (low, high) in enumerate([(0.1, 1.0), (1.0, 2.0)]):
        inside = (size >= low) & (size < high)
        assert pk.modes.iloc[n] == inside.sum() and abs(pk.pk.iloc[n] / power[inside].mean() - 1) < 1e-9
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(np.random.default_rng(0).random((50, 3)) * 34)], "id long, x double, y double, z double")
    force = nbody.force_field(points, mesh).agg(F.sum("ax").alias("x"), F.count("*").alias("n")).first()
    assert abs(force["x"]) < 1e-6 and force["n"] == mesh.size
