"""Resampling the particle sheet: new particles between the lattice's by interpolating displacements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fourier import shifted, transform
from ..operators.mesh import Mesh, cell_id, index_columns, wave_numbers, wrap
from ..operators.particles import shift_vectors


def _moved(cells: DataFrame, mesh: Mesh, names: list[str], shifts: list[tuple[float, ...]], how: str) -> DataFrame:
    """Cells with {name}_{n}: each field at the places moved by the n-th shift. By phases all fields and shifts share one pass each way."""
    if how == "linear":
        out = cells.select(*mesh.cells)
        for n, shift in enumerate(shifts):
            for x in names:
                out = out.join(shifted(cells.select(*mesh.cells, F.col(x).alias("v")), mesh, shift, how).withColumnRenamed("v", f"{x}_{n}"), mesh.cells)
        return out
    method = "slab"
    f = transform(cells.select(*mesh.cells, *[c for x in names for c in (F.col(x), F.lit(0.0).alias(f"_{x}"))]), mesh, tuple((x, f"_{x}") for x in names), method=method)
    ks, cols, pairs = wave_numbers(mesh), [], []
    for n, shift in enumerate(shifts):
        angle = sum((k * s for k, s in zip(ks, shift)), F.lit(0.0))
        f = f.withColumns({f"__c{n}": F.cos(angle), f"__s{n}": F.sin(angle)})
        for x in names:
            c, s = F.col(f"__c{n}"), F.col(f"__s{n}")
            cols += [(F.col(x) * c - F.col(f"_{x}") * s).alias(f"{x}_{n}"), (F.col(x) * s + F.col(f"_{x}") * c).alias(f"_{x}_{n}")]
            pairs.append((f"{x}_{n}", f"_{x}_{n}"))
    return transform(f.select(*mesh.modes, *cols), mesh, tuple(pairs), inverse=True, method=method)


def spawned(psi: DataFrame, mesh: Mesh, resample: int, how: str = "fourier") -> DataFrame:
    """shift, id, x, y, z: resample^dim positions for every lattice cell, from id, sx, sy, sz."""
    names, shifts = [f"s{x}" for x in mesh.places], shift_vectors(mesh, resample)
    moved = _moved(psi.select(*index_columns(F.col("id"), mesh, mesh.cells), *names), mesh, names, shifts, how)
    at = lambda a, n: wrap(F.col(mesh.cells[a]) * (mesh.box / mesh.n) + shifts[n][a] + F.col(f"{names[a]}_{n}"), mesh.box)
    rows = F.array(*[F.struct(F.lit(n).alias("shift"), cell_id(mesh).alias("id"), *[at(a, n).alias(x) for a, x in enumerate(mesh.places)]) for n in range(len(shifts))])
    return moved.select(F.inline(rows))


def property_at(field: DataFrame, mesh: Mesh, resample: int, how: str = "fourier") -> DataFrame:
    """shift, id, v: a lattice field at the spawned particles' Lagrangian places."""
    shifts = shift_vectors(mesh, resample)
    moved = _moved(field, mesh, ["v"], shifts, how)
    return moved.select(F.inline(F.array(*[F.struct(F.lit(n).alias("shift"), cell_id(mesh).alias("id"), F.col(f"v_{n}").alias("v")) for n in range(len(shifts))])))
