"""Reading and writing: spectra as text, particle snapshots as Parquet, and the unit conventions of snapshot formats."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cosmology import Cosmology
from ..operators.mesh import AXES, Mesh, detile, index_columns, nearest_image, stride


def read_spectrum(spark: SparkSession, path: str) -> DataFrame:
    """i, k, pk from a text of two columns; lines that begin with # are comments."""
    line = F.trim("value")
    parts = F.split(line, r"\s+")
    rows = spark.read.text(path).where((line != "") & ~line.startswith("#")).select(parts[0].cast("double").alias("k"), parts[1].cast("double").alias("pk"))
    return rows.withColumn("i", F.row_number().over(Window.orderBy("k")) - 1).select("i", "k", "pk")


def write_spectrum(pk: DataFrame, path: str) -> None:
    """One text file of some thousand lines k pk."""
    pk.orderBy("k").select(F.concat_ws(" ", F.col("k").cast("string"), F.col("pk").cast("string")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


@dataclass(frozen=True)
class Header:
    """What a snapshot says about itself."""

    a: float
    box: float
    count: int
    omega_m: float
    omega_de: float
    h: float
    particle_mass: float = 0.0


def particle_mass(c: Cosmology, box: float, count: int) -> float:
    """Mass of one particle in 1e10 Msun/h: the critical density is 27.7536627 in (1e10 Msun/h) / (Mpc/h)^3."""
    return 27.7536627 * c.Omega_m * box**3 / count


#: Factor on P (in 100 km/s) for the velocities that a format stores, by the power of a; and on lengths, by the power of h.
FORMATS = {"gadget123": (1.5, 0), "gadget4": (1.5, 0), "swift": (1.0, -1)}


def to_units(particles: DataFrame, mesh: Mesh, a: float, h: float, form: str = "gadget123") -> DataFrame:
    """id (unsigned from 1 in files), coordinates and velocities in a format's units, from x and p."""
    power, length = FORMATS[form]
    v, l = 100 / a**power, h**length
    return particles.select("id", *[(F.col(x) * l).alias(x) for x in mesh.places], *[(F.col(f"p{x}") * v).alias(f"v{x}") for x in mesh.places])


def from_units(snapshot: DataFrame, mesh: Mesh, a: float, kpc: bool = False) -> DataFrame:
    """id, x and p (100 km/s) from a snapshot's coordinates, in kpc/h if asked, and peculiar velocities in km/s."""
    l = 1e-3 if kpc else 1.0
    return snapshot.select("id", *[(F.col(x) * l).alias(x) for x in mesh.places], *[(F.col(f"v{x}") / 100 * a).alias(f"p{x}") for x in mesh.places])


def write_snapshot(particles: DataFrame, header: Header, path: str) -> None:
    """A Parquet table, range-partitioned by id, and a header file of JSON beside it."""
    spark = particles.sparkSession
    particles.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/particles")
    spark.createDataFrame([(json.dumps(header.__dict__),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, Header]:
    return spark.read.parquet(f"{path}/particles"), Header(**json.loads(spark.read.text(f"{path}/header").first()[0]))


def write_snapshots(series: DataFrame, path: str) -> None:
    """A time series with a column snap as a table partitioned by it, so that a read of some snapshots opens only those."""
    series.write.mode("overwrite").partitionBy("snap").parquet(path)


def read_snapshots(spark: SparkSession, path: str, snaps: list[int] | None = None, every: int = 1) -> DataFrame:
    """The chosen snapshots (all if None), every so many of them."""
    out = spark.read.parquet(path)
    found = sorted(r[0] for r in out.select("snap").distinct().collect()) if snaps is None else list(snaps)
    return out.where(F.col("snap").isin(found[::every]))


def lattice_order(snapshot: DataFrame, mesh: Mesh, glass: int | None = None, sub: int = 1) -> DataFrame:
    """A snapshot numbered from 1 in blocks of glass tiles as row-major lattice ids, every sub-th particle an axis."""
    ids = (F.col("id") - 1) if glass is not None else F.col("id")
    out = snapshot.withColumn("id", detile(ids, mesh.n // glass, glass) if glass else ids)
    return stride(out, mesh, sub) if sub > 1 else out


def unwrapped(particles: DataFrame, mesh: Mesh) -> DataFrame:
    """Positions moved by whole boxes to lie nearest their lattice places."""
    cells = index_columns(F.col("id"), mesh, mesh.cells)
    out = {}
    for x, c in zip(AXES, cells):
        q = c * (mesh.box / mesh.n)
        out[x] = q + nearest_image(F.col(x) - q, mesh.box)
    return particles.withColumns(out)


#: Lattice side of the glass tiles of the supported simulation suites, and whether lengths are in kpc/h.
SUITES = {"camels_dm": (64, True), "quijote": (64, True), "gadget_generic": (None, False)}


def arranged(rows: DataFrame, header: Header, suite: str, mesh: Mesh, sub: int = 1) -> DataFrame:
    """A suite's stored particles as initial conditions: units, lattice order, subsampling, unwrapping."""
    glass, kpc = SUITES[suite]
    tile = math.gcd(glass, mesh.n) if glass else None
    ordered = lattice_order(from_units(rows, mesh, header.a, kpc), mesh, tile, sub)
    return unwrapped(ordered, mesh.at(mesh.n // sub))


def load(spark: SparkSession, path: str, suite: str, mesh: Mesh, sub: int = 1) -> tuple[DataFrame, Header]:
    """A Parquet snapshot of a suite, arranged."""
    rows, header = read_snapshot(spark, path)
    return arranged(rows, header, suite, mesh, sub), header
