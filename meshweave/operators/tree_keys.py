"""Morton keys of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mesh import Mesh, to_cells


def morton(cells: list[Column], bits: int) -> Column:
    """Interleaved bits of integer coordinates; the first axis has the highest bit of each group."""
    d, key = len(cells), F.lit(0).cast("long")
    for b in range(bits):
        for a, c in enumerate(cells):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1).cast("long")), d * b + d - 1 - a))
    return key


def unmorton(key: Column, dim: int, bits: int) -> list[Column]:
    out = []
    for a in range(dim):
        c = F.lit(0).cast("long")
        for b in range(bits):
            c = c.bitwiseOR(F.shiftleft(F.shiftright(key, dim * b + dim - 1 - a).bitwiseAND(F.lit(1).cast("long")), b))
        out.append(c)
    return out


def keyed(particles: DataFrame, mesh: Mesh, bits: int = 10) -> DataFrame:
    """Particles with the Morton key of their cell on a grid of 2^bits an axis."""
    fine = Mesh(mesh.dim, 1 << bits, mesh.box)
    cells = [F.least(F.floor(to_cells(F.col(x), fine)), F.lit(fine.n - 1)) for x in mesh.places]
    return particles.withColumn("morton", morton(cells, bits))
