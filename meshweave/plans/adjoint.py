"""Reverse derivatives of N-body runs: states are recomputed backwards, cotangents go through each force and step.

A cotangent is one row a particle: id, gsx, gsy, gsz for displacements and gvx, gvy, gvz for momenta.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fourier import gradient_kernel, inverse_laplacian_kernel, transform, without_mean
from ..operators.mesh import AXES, Mesh, positions_from_displacement
from ..operators.particles import deposit, gather, overdensity
from .nbody import Step, drift, inverse_step


def _spectra(cells: DataFrame, mesh: Mesh, names: tuple[str, ...]) -> DataFrame:
    """Spectra r{n}, i{n} of real fields in one pass."""
    parts = cells.select(*mesh.cells, *[c for n in names for c in (F.col(n).alias(f"r{n}"), F.lit(0.0).alias(f"i{n}"))])
    return transform(parts, mesh, tuple((f"r{n}", f"i{n}") for n in names), method="slab")


def force_adjoint(particles: DataFrame, cotangent: DataFrame, mesh: Mesh, order: int = 2, count: int | None = None) -> DataFrame:
    """id and gx, gy, gz: the transpose of the particle-mesh force's derivative by positions, applied to id, ga{axis}.

    Three parts: the gather's weights move with the particles; the gathered field's cotangent is a deposit, goes back
    through the kernel's transpose, and reaches the positions through the first deposit's weights.
    """
    axes = AXES[: mesh.dim]
    n = count or particles.count()
    delta = without_mean(_spectra(overdensity(particles, mesh, order, n), mesh, ("v",)).select(*mesh.modes, F.col("rv").alias("re"), F.col("iv").alias("im")), mesh)
    green = -inverse_laplacian_kernel(mesh)
    cols, pairs = [], []
    for d, x in enumerate(axes):
        k = gradient_kernel(mesh, d) * green
        cols += [(-F.col("im") * k).alias(f"f{x}"), (F.col("re") * k).alias(f"_{x}")]
        pairs.append((f"f{x}", f"_{x}"))
    method = "slab"
    field = transform(delta.select(*mesh.modes, *cols), mesh, tuple(pairs), inverse=True, method=method)
    slopes = gather(field, particles, mesh, order, tuple(f"f{x}" for x in axes), gradient=True)
    carried = particles.select("id", *axes).join(cotangent, "id")
    pulled = _spectra(deposit(carried, mesh, order, {f"h{x}": F.col(f"ga{x}") for x in axes}), mesh, tuple(f"h{x}" for x in axes))
    re, im = F.lit(0.0), F.lit(0.0)
    for d, x in enumerate(axes):
        k = gradient_kernel(mesh, d) * green
        re, im = re + F.col(f"ih{x}") * k, im - F.col(f"rh{x}") * k
    back = without_mean(pulled.select(*mesh.modes, re.alias("re"), im.alias("im")), mesh)
    source = transform(back, mesh, inverse=True, method=method).select(*mesh.cells, (F.col("re") * (mesh.size / n)).alias("c"))
    moved = gather(source, particles, mesh, order, ("c",), gradient=True).select("id", *[F.col(f"dc_d{x}").alias(f"c{x}") for x in axes])
    both = slopes.join(cotangent, "id").join(moved, "id")
    return both.select("id", *[sum((F.col(f"ga{y}") * F.col(f"df{y}_d{x}") for y in axes), F.col(f"c{x}")).alias(f"g{x}") for x in axes])


def step_adjoint(state: DataFrame, cotangent: DataFrame, mesh: Mesh, grid: Mesh, step: Step, order: int = 2) -> DataFrame:
    """The cotangent before a step from the one after it and the state before it."""
    axes = AXES[: mesh.dim]
    at = positions_from_displacement(drift(state, mesh, step.drift1), mesh)
    g = cotangent.withColumns({f"gv{x}": F.col(f"gv{x}") + F.col(f"gs{x}") * step.drift2 for x in axes})
    through = force_adjoint(at, g.select("id", *[(F.col(f"gv{x}") * step.beta).alias(f"ga{x}") for x in axes]), grid, order)
    out = g.join(through, "id")
    return out.select("id", *[(F.col(f"gs{x}") + F.col(f"g{x}")).alias(f"gs{x}") for x in axes], *[(F.col(f"gv{x}") * step.alpha + (F.col(f"gs{x}") + F.col(f"g{x}")) * step.drift1).alias(f"gv{x}") for x in axes])


def run_adjoint(final: DataFrame, cotangent: DataFrame, mesh: Mesh, grid: Mesh, steps: list[Step], order: int = 2) -> tuple[DataFrame, DataFrame]:
    """The first state and the cotangent there, from the last state and its cotangent: no state of the forward run is kept."""
    for step in reversed(steps):
        final = inverse_step(final, mesh, grid, step, "pm", order=order).checkpoint()
        cotangent = step_adjoint(final, cotangent, mesh, grid, step, order).checkpoint()
    return final, cotangent
