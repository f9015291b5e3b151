"""Derivatives through whole operators: of a power spectrum by every particle's position, and of forces along tangents.

Both are dataflow of the same shape as the operator itself. Backwards, the weights of the bins become factors of the
modes, one inverse transform makes them a cotangent of the cells, and the deposit's transpose takes it to the particles.
Forwards, each field is carried with its tangent through deposit, transform, kernel and gather in one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fourier import assignment_kernel, gradient_kernel, inverse_laplacian_kernel, real_backward, real_forward
from ..operators.mesh import AXES, Mesh, fourier_grid, multiplicity, wave_square
from ..operators.particles import deposit_adjoint, deposit_tangent, gather, overdensity
from ..operators.statistics import bin_edges, bin_of


def spectrum_adjoint(delta: DataFrame, mesh: Mesh, weights: list[float], bins: int | tuple[float, ...], logarithmic: bool = True) -> DataFrame:
    """The derivative of the weighted sum of a power spectrum's bins by each cell of the field, as v. Bins without modes count nothing."""
    edges = bin_edges(mesh, bins, logarithmic)
    if len(weights) != len(edges) - 1:
        raise ValueError(f"{len(edges) - 1} bins and {len(weights)} weights")
    place = bin_of(F.sqrt(wave_square(mesh)), edges)
    counts = fourier_grid(delta.sparkSession, mesh).withColumn("__b", place).where("__b IS NOT NULL").groupBy("__b").agg(F.sum(multiplicity(mesh)).alias("__n"))  # one row a bin
    scale = 2 * mesh.box**mesh.dim / mesh.size  # twice the modes' norm V / N^2, and N for the inverse transform's share
    factor = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("__b").cast("int")) * scale / F.col("__n")
    modes = real_forward(delta, mesh).withColumn("__b", place).join(F.broadcast(counts), "__b").withColumn("__c", factor)
    return real_backward(modes.select(*mesh.modes, (F.col("re") * F.col("__c")).alias("re"), (F.col("im") * F.col("__c")).alias("im")), mesh)


def spectrum_gradient(particles: DataFrame, mesh: Mesh, weights: list[float], bins: int | tuple[float, ...], order: int = 2, logarithmic: bool = True) -> DataFrame:
    """id and gx, gy, gz: the derivative by each position of the weighted sum of the bins of the particles' power spectrum.

    Deposits of order 1 do not change with positions. Particles without a place have no row.
    """
    there = particles.where(" AND ".join(f"{x} IS NOT NULL" for x in mesh.places))
    total = there.agg(F.count("*").alias("__total"))
    cotangent = spectrum_adjoint(overdensity(there, mesh, order), mesh, weights, bins, logarithmic)
    by_mass = cotangent.join(F.broadcast(total), how="cross").select(*mesh.cells, (F.col("v") * (mesh.size / F.col("__total"))).alias("v"))  # delta = rho / mean - 1
    return deposit_adjoint(by_mass, there, mesh, order).select("id", *[f"g{x}" for x in mesh.places])


def force_tangent(particles: DataFrame, mesh: Mesh, order: int = 2, deconvolve: bool = False, gradient_order: int = 0, laplace_order: int = 0, alpha: float | None = None) -> DataFrame:
    """id, ax, ay, az and tax, tay, taz: the particle-mesh force and its derivative along the particles' tangents tx, ty, tz.

    The deposit and its tangent, their spectra, and the fields of all axes of both are one transform each way; the gather
    adds what the moving stencil sees of the field to the field's own change.
    """
    axes = AXES[: mesh.dim]
    there = particles.where(" AND ".join(f"{x} IS NOT NULL" for x in mesh.places))
    total = there.agg(F.count("*").alias("__total"))
    mean = F.col("__total") / mesh.size
    both = deposit_tangent(there, mesh, order).join(F.broadcast(total), how="cross").select(*mesh.cells, (F.col("v") / mean - 1).alias("r0"), (F.col("dv") / mean).alias("r1"))
    spectra = real_forward(both, mesh, (("r0", "i0"), ("r1", "i1")), method="slab")
    kernel = -inverse_laplacian_kernel(mesh, laplace_order)
    if deconvolve:
        kernel = kernel * assignment_kernel(mesh, order, twice=True)
    if alpha is not None:
        kernel = kernel * F.exp(wave_square(mesh) * (-0.5 * alpha**2))
    mean_mode = sum((F.col(j) for j in mesh.modes[1:]), F.col(mesh.modes[0])) == 0
    spectra = spectra.withColumn("__g", F.when(mean_mode, 0.0).otherwise(kernel))
    columns, pairs = [], []
    for n, prefix in ((0, "a"), (1, "t")):
        for d, x in enumerate(axes):
            k = gradient_kernel(mesh, d, gradient_order) * F.col("__g")
            columns += [(-F.col(f"i{n}") * k).alias(f"{prefix}{x}"), (F.col(f"r{n}") * k).alias(f"__{prefix}{x}")]
            pairs.append((f"{prefix}{x}", f"__{prefix}{x}"))
    fields = real_backward(spectra.select(*mesh.modes, *columns), mesh, tuple(pairs), None, "slab")
    names = tuple(f"{p}{x}" for p in "at" for x in axes)
    seen = gather(fields, there, mesh, order, names, gradient=True).join(there.select("id", *[F.col(f"t{x}").alias(f"__t{x}") for x in axes]), "id")
    moved = lambda x: sum((F.col(f"da{x}_d{y}") * F.col(f"__t{y}") for y in axes), F.col(f"t{x}"))
    return seen.select("id", *[f"a{x}" for x in axes], *[moved(x).alias(f"ta{x}") for x in axes])
