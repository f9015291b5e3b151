"""Interpolation by arrays and as an as-of join against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshweave.functions import cosmology as C
from meshweave.operators import asof


def tables(spark, knots=300, probes=900, seed=1):
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(-1000, 1000, knots)) / 8.0
    y, z = rng.normal(size=len(x)), rng.normal(size=len(x))
    order = rng.permutation(len(x))
    table = spark.createDataFrame([(float(x[i]), float(y[i]), float(z[i]), "k") for i in order] + [(float(x[0]), 1e9, 0.0, "again"), (None, 1.0, 1.0, "none"), (3.3, float("nan"), 1.0, "nan")], "k double, y double, z double, name string")
    at = np.concatenate([rng.uniform(-150, 150, probes), x[rng.integers(0, len(x), 60)], np.full(500, 12.0625), [-1e9, 1e9, x[0], x[-1]]])
    asked = spark.createDataFrame([(i, float(v), "p") for i, v in enumerate(at)] + [(-1, None, "p"), (-2, float("nan"), "p")], "id long, x double, name string").repartition(4)
    return table, asked, x, y, z, at


@pytest.mark.parametrize(("small", "ranges"), [(1000, None), (0, 1), (0, 13)])
def test_against_numpy(spark, small, ranges):
    table, asked, x, y, z, at = tables(spark)
    out = asof.interpolate(table, asked, "k", ("y", "z"), into=("y", "w"), small=small, ranges=ranges)
    assert out.columns == ["id", "x", "name", "y", "w"]
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(at) + 2 and got[-1]["y"] is None and got[-2]["w"] is None and {r["name"] for r in got.values()} == {"p"}
    assert np.allclose([got[i]["y"] for i in range(len(at))], np.interp(at, x, y), atol=1e-12)
    assert np.allclose([got[i]["w"] for i in range(len(at))], np.interp(at, x, z), atol=1e-12)


def test_equal_probes_are_shared_out(spark):
    """A probe that is most of all rows lies in several ranges, far from the knot before it."""
    table = spark.createDataFrame([(0.0, 1.0), (1.0, 3.0)], "k double, y double")
    asked = spark.range(4000).select("id", F.lit(0.25).alias("x"))
    out = asof.interpolate(table, asked, "k", "y", small=0, ranges=8)
    parts = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.min("y").alias("low"), F.max("y").alias("high")).collect()
    assert max(p["n"] for p in parts) < 1500 and {(p["low"], p["high"]) for p in parts} == {(1.5, 1.5)}


def test_one_knot_no_knot_no_probe(spark):
    one, none = spark.createDataFrame([(2.0, 7.0)], "k double, y double"), spark.createDataFrame([], "k double, y double")
    asked = spark.createDataFrame([(1, 0.0), (2, 9.0)], "id long, x double")
    for small in (10, 0):
        assert {r["y"] for r in asof.interpolate(one, asked, "k", "y", small=small).collect()} == {7.0}
        assert {r["y"] for r in asof.interpolate(none, asked, "k", "y", small=small).collect()} == {None}
        assert asof.interpolate(one, asked.limit(0), "k", "y", small=small).collect() == []


def test_a_million_knots(spark):
    table = spark.range(1_000_000).select((F.col("id") / 1000).alias("k"), F.sin(F.col("id") / 1000).alias("y"))
    asked = spark.range(2000).select("id", (F.col("id") * 0.4999).alias("x"))
    out = asof.interpolate(table, asked, "k", "y")
    assert out.where(F.abs(F.col("y") - F.sin("x")) < 1e-6).count() == 2000


def test_time_columns(spark):
    """Scale factor, superconformal time and growth, there and back, and growth rates, as columns and as numbers."""
    times = C.Times.of(C.PLANCK15)
    a = np.linspace(0.01, 1.0, 50)
    df = spark.createDataFrame([(float(v),) for v in a] + [(None,)], "a double")
    s = times.column("superconft", "a")
    rows = df.select("a", s.alias("s"), times.column("a", s, "superconft").alias("back"), times.column("a", times.column("Dplus", "a"), "Dplus").alias("grown"), times.growth_rate_column("a").alias("rate"), times.fplus_column("a").alias("f")).orderBy("a").collect()
    assert tuple(rows[0]) == (None,) * 6
    got = np.array([tuple(r) for r in rows[1:]])
    assert np.allclose(got[:, 1], times.get("superconft", a)) and np.allclose(got[:, 2], a) and np.allclose(got[:, 3], a)
    assert np.allclose(got[:, 4], times.growth_rate(a)) and np.allclose(got[:, 5], times.fplus(a))
