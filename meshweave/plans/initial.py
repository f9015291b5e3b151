"""Initial conditions: noise, Gaussian fields and plane waves."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cosmology import Cosmology, Times, expansion, expansion_slope
from ..operators.fourier import forward, hermitian, full_from_half, inverse_laplacian_kernel, mode_order, scaled, without_mean
from ..operators.mesh import Mesh, fourier_grid, grid, index_columns, spherical, wave_square
from ..operators.nufft import type2


def uniform(seed: int, number: int, *keys: Column) -> Column:
    """A number in (0, 1) from a hash of the keys: the same whatever the partitions."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(number), *keys), 11) + 0.5) * 2.0**-53


def normal_pair(seed: int, *keys: Column) -> tuple[Column, Column]:
    """Two independent normal numbers by Box and Muller."""
    r = F.sqrt(-2 * F.log(uniform(seed, 1, *keys)))
    angle = 2 * math.pi * uniform(seed, 2, *keys)
    return r * F.cos(angle), r * F.sin(angle)


def white_noise(spark: SparkSession, mesh: Mesh, seed: int) -> DataFrame:
    """Unit normal v on every cell."""
    return grid(spark, mesh).select(*mesh.cells, normal_pair(seed, F.col("id"))[0].alias("v"))


def fourier_noise(spark: SparkSession, mesh: Mesh, seed: int, order: str | None = "stable") -> DataFrame:
    """Full spectrum of unit white noise, drawn mode by mode: with the stable order a finer mesh has the same large scales."""
    modes = fourier_grid(spark, mesh).select("id", *mesh.modes)
    ranked = mode_order(modes, mesh, order) if order else modes.withColumn("rank", F.col("id"))
    a, b = normal_pair(seed, F.col("rank"))
    scale = math.sqrt(mesh.size / 2)
    drawn = ranked.select(*mesh.modes, (a * scale).alias("re"), (b * scale).alias("im"))
    last = F.col(mesh.modes[-1])
    # a mode that is its own mirror has all its power in the real part
    own = (last == 0) | (last == mesh.n // 2)
    for j in mesh.modes[:-1]:
        own = own & ((F.col(j) == 0) | (F.col(j) == mesh.n // 2))
    drawn = drawn.withColumn("re", F.when(own, F.col("re") * math.sqrt(2)).otherwise(F.col("re")))
    return full_from_half(hermitian(drawn, mesh), mesh)


def with_spectrum(noise: DataFrame, mesh: Mesh, pk: DataFrame) -> DataFrame:
    """Spectrum of the potential phi (with delta its Laplacian) from the spectrum of white noise and a table i, k, pk with geometric spacing."""
    ends = pk.agg(F.array_sort(F.collect_list(F.struct("k", "pk"))).alias("__t"))
    k = F.sqrt(wave_square(mesh))
    rows = noise.join(F.broadcast(ends), how="cross").withColumn("__k", k)
    size = F.size("__t")
    first, last = F.element_at("__t", F.lit(1))["k"], F.element_at("__t", size)["k"]
    guess = F.floor(F.log(F.greatest("__k", first) / first) / F.log(last / first) * (size - 1)) + 1
    low = F.greatest(F.lit(1), F.least(guess, size - 1)).cast("int")
    p, q = F.element_at("__t", low), F.element_at("__t", low + 1)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("__k") - p["k"]) / (q["k"] - p["k"])))
    power = p["pk"] + t * (q["pk"] - p["pk"])
    amplitude = F.sqrt(power * (mesh.n / mesh.box) ** mesh.dim)
    shaped = rows.withColumn("__f", amplitude).select(*mesh.modes, (F.col("re") * F.col("__f")).alias("re"), (F.col("im") * F.col("__f")).alias("im"))
    return without_mean(scaled(shaped, inverse_laplacian_kernel(mesh)), mesh)


def gaussian_potential(spark: SparkSession, mesh: Mesh, pk: DataFrame, seed: int = 0, space: str = "real", noise: DataFrame | None = None, order: str | None = "stable", sphere: bool = False) -> DataFrame:
    """Full spectrum of a Gaussian potential, from drawn or given white noise in real or Fourier space."""
    if space == "real":
        base = forward(noise if noise is not None else white_noise(spark, mesh, seed), mesh)
    elif space == "fourier":
        base = noise if noise is not None else fourier_noise(spark, mesh, seed, order)
    else:
        raise ValueError("real or fourier")
    out = with_spectrum(base, mesh, pk)
    return spherical(out, mesh) if sphere else out


def evaluated_at(potential: DataFrame, mesh: Mesh, places: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Spectrum of the potential's values at one place id, x, y, z a cell (moved or glass-like lattices), by a non-uniform transform."""
    at = type2(potential.select(*mesh.modes, "re", "im"), places, mesh, eps)
    return forward(at.select(*index_columns(F.col("id"), mesh, mesh.cells), (F.col("re") / mesh.size).alias("v")), mesh)


def plane_wave(times: Times, mesh: Mesh, a: float, a_cross: float = 1.0, mode: int = 1, decaying: float = 0.0) -> dict[str, Column]:
    """Exact position, momentum, potential and density of a plane wave along x at Lagrangian position qx, until it crosses itself at a_cross."""
    c: Cosmology = times.cosmology
    grow, cross = float(times.get("Dplus", a)), float(times.get("Dplus", a_cross))
    e, de = float(expansion(c, np.float64(a), np)), float(expansion_slope(c, np.float64(a), np))
    k = 2 * math.pi * mode / mesh.box
    s, o = F.sin(F.col("qx") * k), F.cos(F.col("qx") * k)
    up, down = s / (k * cross), o * (decaying / k)
    return {
        "x": F.col("qx") + up * grow + down * e,
        "px": (up * float(times.get("Dplusda", a)) + down * de) * (a**3 * e),
        "phi": o * (grow / (k**2 * cross)) - s * (e * decaying / k**2),
        "delta": -o * (grow / cross) + s * (e * decaying),
    }


def validated(df: DataFrame, mesh: Mesh, columns: tuple[str, ...]) -> DataFrame:
    """External initial conditions: the columns must be there and the rows as many as the mesh has cells."""
    missing = [c for c in columns if c not in df.columns]
    if missing or df.count() != mesh.size:
        raise ValueError(f"needs columns {columns} and {mesh.size} rows")
    return df
