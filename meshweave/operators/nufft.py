"""Non-uniform Fourier transforms by spreading with the "exponential of semicircle" kernel (arXiv:1808.06736).

Type 1 takes points to modes: an explode over width^dim fine cells, one aggregate, a transform on a grid twice as
fine, a crop, and a division by the kernel's own transform. Type 2 takes modes to points by the same steps backwards,
with a gradient if asked.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fourier import gradient_kernel, inverse_laplacian_kernel, transform, without_mean
from .mesh import AXES, Mesh, signed, to_cells
from .particles import held

SIGMA = 2


def kernel_width(eps: float) -> int:
    """Cells an axis for a relative accuracy."""
    return max(3, min(14, math.ceil(math.log10(10 / eps)) + 1))


def shape(width: int) -> float:
    """The kernel's exponent for an upsampling of two."""
    return 2.30 * width


def legendre(points: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights on [-1, 1]."""
    return np.polynomial.legendre.leggauss(points)


def kernel_transform(n: int, width: int, points: int = 64) -> np.ndarray:
    """The kernel's Fourier transform at the modes 0 .. n/2 of a mesh of n, on the grid of SIGMA n cells, in units of its cell."""
    nodes, weights = legendre(points)
    beta, half = shape(width), width / 2
    phi = np.exp(beta * (np.sqrt(1 - nodes**2) - 1))
    k = 2 * math.pi * np.arange(n // 2 + 1) / (SIGMA * n)
    return half * (weights * phi * np.cos(k[:, None] * half * nodes)).sum(1)


def _spread(points: DataFrame, fine: Mesh, width: int, slopes: bool) -> DataFrame:
    beta, half = shape(width), width / 2
    out, kept = points, points.columns
    for x, i in zip(AXES, fine.cells):
        out = out.withColumn(f"__g{i}", to_cells(F.col(x), fine))
        out = out.withColumn(f"__b{i}", F.ceil(F.col(f"__g{i}") - half).cast("int"))
        out = out.withColumn(f"__c{i}", F.explode(F.array(*[F.col(f"__b{i}") + o for o in range(width)])))
        out = out.withColumn(f"__z{i}", (F.col(f"__c{i}") - F.col(f"__g{i}")) / half).withColumn(f"__c{i}", F.pmod(f"__c{i}", F.lit(fine.n)))
        out = out.withColumn(f"__r{i}", F.sqrt(F.greatest(F.lit(0.0), 1 - F.col(f"__z{i}") * F.col(f"__z{i}")))).withColumn(f"__w{i}", F.exp((F.col(f"__r{i}") - 1) * beta))
        if slopes:
            out = out.withColumn(f"__d{i}", F.when(F.col(f"__r{i}") > 0, F.col(f"__w{i}") * (F.col(f"__z{i}") * beta) / F.col(f"__r{i}")).otherwise(0.0) / half * (fine.n / fine.box))

    def product(pick: int | None) -> Column:
        w = None
        for n, i in enumerate(fine.cells):
            c = F.col(f"__{'d' if n == pick else 'w'}{i}")
            w = c if w is None else w * c
        return w

    more = [product(n).alias(f"__d{x}") for n, x in enumerate(AXES[: fine.dim])] if slopes else []
    return out.select(*kept, *[F.col(f"__c{i}").alias(i) for i in fine.cells], product(None).alias("__w"), *more)


def _correction(mesh: Mesh, width: int) -> Column:
    """One over the product of the kernel's transforms, from an array of n/2 + 1 literals."""
    table = F.array(*map(F.lit, (1 / kernel_transform(mesh.n, width)).tolist()))
    out = F.lit(1.0)
    for j in mesh.modes:
        out = out * F.get(table, F.abs(signed(F.col(j), mesh.n)))
    return out


def type1(points: DataFrame, mesh: Mesh, eps: float = 1e-6, re: str = "re", im: str | None = None) -> DataFrame:
    """Modes f(k) = sum c exp(-i k x) of points x, y, z with strengths; the Nyquist modes are those of -n/2."""
    width, fine = kernel_width(eps), mesh.at(SIGMA * mesh.n)
    at = points.select(*mesh.places, F.col(re).alias("__re"), (F.col(im) if im else F.lit(0.0)).alias("__im"))
    cells = _spread(at, fine, width, False).groupBy(*fine.cells).agg(F.sum(F.col("__w") * F.col("__re")).alias("re"), F.sum(F.col("__w") * F.col("__im")).alias("im"))
    modes = transform(cells, fine, method="slab")
    for j in mesh.modes:
        s = signed(F.col(j), fine.n)
        modes = modes.where((s >= -(mesh.n // 2)) & (s < mesh.n // 2))
    kept = modes.select(*[F.pmod(signed(F.col(j), fine.n), F.lit(mesh.n)).cast("int").alias(j) for j in mesh.modes], "re", "im")
    return kept.withColumn("__c", _correction(mesh, width)).select(*mesh.modes, (F.col("re") * F.col("__c")).alias("re"), (F.col("im") * F.col("__c")).alias("im"))


def type2(spectrum: DataFrame, points: DataFrame, mesh: Mesh, eps: float = 1e-6, gradient: bool = False, values: tuple[tuple[str, str], ...] = (("re", "im"),)) -> DataFrame:
    """id and f(x) = sum f(k) exp(i k x) (unscaled) at points, and d{part}_d{axis} if asked; several fields in one pass."""
    width, fine = kernel_width(eps), mesh.at(SIGMA * mesh.n)
    parts = [c for p in values for c in p]
    sp = spectrum.withColumn("__c", _correction(mesh, width)).select(*[F.pmod(signed(F.col(j), mesh.n), F.lit(fine.n)).cast("int").alias(j) for j in mesh.modes], *[(F.col(c) * F.col("__c") * fine.size).alias(c) for c in parts])
    cells = transform(sp, fine, values, inverse=True, method="slab")
    met = _spread(points.select("id", *mesh.places), fine, width, gradient).join(held(cells, fine), fine.cells)
    sums = [F.sum(F.col("__w") * F.col(c)).alias(c) for c in parts]
    if gradient:
        sums += [F.sum(F.col(f"__d{x}") * F.col(c)).alias(f"d{c}_d{x}") for c in parts for x in AXES[: mesh.dim]]
    return met.groupBy("id").agg(*sums)


def direct(points: DataFrame, mesh: Mesh) -> DataFrame:
    """Type 1 by definition, in Arrow batches of points with one partial sum a task: for few modes, and for tests."""
    n, d, box, places, modes = mesh.n, mesh.dim, mesh.box, mesh.places, mesh.modes

    def run(parts):
        grid = np.indices((n,) * d).reshape(d, -1)
        k = np.where(grid < n // 2, grid, grid - n) * 2 * math.pi / box
        total = np.zeros(n**d, dtype=complex)
        for pdf in parts:
            for at in range(0, len(pdf), 512):
                x = pdf[places].to_numpy(float)[at : at + 512]
                total += (pdf["re"].to_numpy()[at : at + 512, None] * np.exp(-1j * x @ k)).sum(0)
        yield pd.DataFrame({**{m: g for m, g in zip(modes, grid)}, "re": total.real, "im": total.imag})

    schema = ", ".join([*[f"{m} int" for m in modes], "re double", "im double"])
    return points.select(*places, "re").mapInPandas(run, schema).groupBy(*modes).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def nufft_force(particles: DataFrame, mesh: Mesh, eps: float = 1e-6, from_kernel: bool = False) -> DataFrame:
    """id and ax, ay, az: the mesh force without a deposit's aliases; the gradient in Fourier space, or of the kernel."""
    count = particles.count()
    modes = type1(particles.select("id", *mesh.places, F.lit(1.0).alias("re")), mesh, eps)
    f = without_mean(modes, mesh).withColumn("__g", -inverse_laplacian_kernel(mesh) / count)
    for j in mesh.modes:
        f = f.where(F.col(j) != mesh.n // 2)
    if from_kernel:
        phi = f.select(*mesh.modes, (F.col("re") * F.col("__g")).alias("re"), (F.col("im") * F.col("__g")).alias("im"))
        out = type2(phi, particles, mesh, eps, gradient=True)
        return out.select("id", *[F.col(f"dre_d{x}").alias(f"a{x}") for x in mesh.places])
    cols, pairs = [], []
    for d, x in enumerate(mesh.places):
        k = gradient_kernel(mesh, d) * F.col("__g")
        cols += [(-F.col("im") * k).alias(f"a{x}"), (F.col("re") * k).alias(f"__{x}")]
        pairs.append((f"a{x}", f"__{x}"))
    return type2(f.select(*mesh.modes, *cols), particles, mesh, eps, values=tuple(pairs)).select("id", *[f"a{x}" for x in mesh.places])
