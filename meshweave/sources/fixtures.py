"""Particles, meshes and tables derived from the driver's tables, as both engines can compute them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mesh import Mesh
from ..operators.particles import overdensity

BOX = 100.0
MESH = Mesh(3, 8, BOX)


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y, z, v of events: places in the box from the key, the value and the time of day."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("event_id").alias("id"),
        (F.pmod(F.col("event_id") * 7919 + F.col("user_id") * 104729, F.lit(100003)).cast("double") / F.lit(100003.0).cast("double") * BOX).alias("x"),
        F.pmod(F.col("value") * 37, F.lit(BOX)).alias("y"),
        (F.pmod(micros, F.lit(86400000000)).cast("double") / F.lit(86400000000.0).cast("double") * BOX).alias("z"),
        F.col("value").alias("v"),
    )


def moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The particles with momenta px, py, pz from their value."""
    p = particles(spark, sf_dir)
    return p.select("id", "x", "y", "z", (F.col("v") / 100).alias("px"), (F.col("v") / 200 - 0.1).alias("py"), (F.col("v") / 50 - 0.5).alias("pz"))


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, p of orders on a line."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("id"), F.pmod(F.col("o_totalprice"), F.lit(BOX)).alias("x"), (F.col("o_totalprice") / 500000).alias("p"))


def field(spark: SparkSession, sf_dir: str, mesh: Mesh = MESH) -> DataFrame:
    """The overdensity of the particles on a mesh."""
    return overdensity(particles(spark, sf_dir), mesh)


def spectrum_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, k, pk: a wave number for each whole value of the events."""
    i = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.floor("value").cast("int").alias("i")).distinct()
    k = F.pow((F.col("i") + 1).cast("double"), 1.5) * 1e-3
    return i.select("i", k.alias("k"), (k / F.pow(1 + F.pow(k / 0.02, 2), 2)).alias("pk"))


def wave_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, k of every event."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), (0.001 + F.col("value") / 100).alias("k"))


def scale_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, a of every event."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), (0.05 + F.col("value") / 100).alias("a"))


def time_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, a: a scale factor for each whole value of the events, up to 1."""
    i = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.floor("value").cast("int").alias("i")).distinct()
    return i.join(F.broadcast(i.agg(F.max("i").alias("most"))), how="cross").select("i", ((F.col("i") + 1) / (F.col("most") + 1)).alias("a"))
