"""Propagator perturbation theory: the wave function of the initial potential, propagated freely or kick-drift-kick."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.fourier import gradient_kernel, transform
from ..operators.mesh import Mesh, wave_numbers, wave_square


def _times(re: str, im: str, angle: Column) -> tuple[Column, Column]:
    """(re + i im) exp(i angle)."""
    return F.col(re) * F.cos(angle) - F.col(im) * F.sin(angle), F.col(re) * F.sin(angle) + F.col(im) * F.cos(angle)


def planck(phi: DataFrame, mesh: Mesh, safety: float = 1.1) -> float:
    """Smallest h_bar that resolves the phase: the largest step of the potential between neighbours over pi."""
    steps = []
    for i in mesh.cells:
        moved = phi.select(*[(F.pmod(F.col(c) + 1, F.lit(mesh.n)).cast("int") if c == i else F.col(c)).alias(c) for c in mesh.cells], F.col("v").alias("__b"))
        steps.append(phi.join(moved, mesh.cells).agg(F.max(F.abs(F.col("v") - F.col("__b"))).alias("s")))
    total = steps[0]
    for s in steps[1:]:
        total = total.unionByName(s)
    return safety / math.pi * float(total.agg(F.max("s")).first()[0])


def propagate(phi: DataFrame, mesh: Mesh, growth: float, h_bar: float | None = None, growth_rate: float | None = None, second: DataFrame | None = None, lyman: tuple[float, float] | None = None) -> tuple[DataFrame, float]:
    """Cells with rho - 1 as delta, the momentum density j0 ..., and in redshift space (with a growth rate) delta_rsd; tau = A rho^beta and tau_rsd for lyman = (A, beta).

    second: the second-order potential on the mesh, for a kick before and after the drift.
    """
    h = h_bar or planck(phi, mesh)
    start = phi.select(*mesh.cells, F.col("v").alias("__phi"))
    if second is not None:
        start = start.join(second.select(*mesh.cells, F.col("v").alias("__two")), mesh.cells).withColumn("__phi", F.col("__phi") + F.col("__two") * (growth / 2))
    method = "slab"
    wave = start.select(*mesh.cells, F.cos(F.col("__phi") / h).alias("re"), (-F.sin(F.col("__phi") / h)).alias("im"))
    spectrum = transform(wave, mesh, method=method)
    drift = wave_square(mesh) * (-0.5 * h * growth)
    re, im = _times("re", "im", drift)
    spectrum = spectrum.select(*mesh.modes, re.alias("re"), im.alias("im")).checkpoint()
    if second is not None:
        cells = transform(spectrum, mesh, inverse=True, method=method).join(second.select(*mesh.cells, F.col("v").alias("__two")), mesh.cells)
        re, im = _times("re", "im", F.col("__two") * (-growth / 2 / h))
        spectrum = transform(cells.select(*mesh.cells, re.alias("re"), im.alias("im")), mesh, method=method).checkpoint()
    cols, pairs = [F.col("re"), F.col("im")], [("re", "im")]
    for d in range(mesh.dim):
        k = gradient_kernel(mesh, d)
        cols += [(-F.col("im") * k).alias(f"g{d}"), (F.col("re") * k).alias(f"h{d}")]
        pairs.append((f"g{d}", f"h{d}"))
    rsd = None
    if growth_rate is not None:
        rsd = wave_numbers(mesh)[-1] ** 2 * (-0.5 * h * growth_rate * growth)
        a, b = _times("re", "im", rsd)
        cols += [a.alias("zr"), b.alias("zi")]
        pairs.append(("zr", "zi"))
    cells = transform(spectrum.select(*mesh.modes, *cols), mesh, tuple(pairs), inverse=True, method=method)
    rho = F.col("re") ** 2 + F.col("im") ** 2
    out = [(rho - 1).alias("delta"), *[((F.col("re") * F.col(f"h{d}") - F.col("im") * F.col(f"g{d}")) * h).alias(f"j{d}") for d in range(mesh.dim)]]
    if rsd is not None:
        out.append((F.col("zr") ** 2 + F.col("zi") ** 2 - 1).alias("delta_rsd"))
    if lyman is not None:
        scale, beta = lyman
        out.append((scale * F.pow(rho, beta)).alias("tau"))
    result = cells.select(*mesh.cells, *out)
    if lyman is not None and rsd is not None:
        root = F.sqrt(F.try_divide(scale * F.pow(rho, beta), F.when(rho > 0, rho)))
        chi = cells.select(*mesh.cells, (F.coalesce(root, F.lit(0.0)) * F.col("re")).alias("re"), (F.coalesce(root, F.lit(0.0)) * F.col("im")).alias("im"))
        a, b = _times("re", "im", rsd)
        moved = transform(transform(chi, mesh, method=method).select(*mesh.modes, a.alias("re"), b.alias("im")), mesh, inverse=True, method=method)
        result = result.join(moved.select(*mesh.cells, (F.col("re") ** 2 + F.col("im") ** 2).alias("tau_rsd")), mesh.cells)
    return result, h
