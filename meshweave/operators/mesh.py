"""Periodic meshes as rows: grids, wrapping, cropping, slices and subsampling.

A mesh of dim dimensions has integer columns ix, iy, iz (as many as dim) from 0 to n - 1 and value columns; a
spectrum has jx, jy, jz in transform order (0 .. n/2 - 1, -n/2 .. -1 stored as 0 .. n - 1). The id of a cell is its
row-major index. Absent rows of a spectrum are zeros, so padding it costs nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


@dataclass(frozen=True)
class Mesh:
    """dim dimensions of n cells over a periodic box of that length."""

    dim: int
    n: int
    box: float

    def __post_init__(self):
        if self.dim not in (1, 2, 3) or self.n < 2 or self.n % 2 or self.box <= 0:
            raise ValueError("1 to 3 dimensions, an even number of cells and a positive box")

    @property
    def cells(self) -> list[str]:
        return [f"i{x}" for x in AXES[: self.dim]]

    @property
    def modes(self) -> list[str]:
        return [f"j{x}" for x in AXES[: self.dim]]

    @property
    def places(self) -> list[str]:
        return list(AXES[: self.dim])

    @property
    def size(self) -> int:
        return self.n**self.dim

    @property
    def fundamental(self) -> float:
        return 2 * math.pi / self.box

    @property
    def nyquist(self) -> float:
        return math.pi * self.n / self.box

    def at(self, n: int) -> Mesh:
        return replace(self, n=n)


def index_columns(id_col: Column, mesh: Mesh, names: list[str]) -> list[Column]:
    """Row-major index to one integer column for each axis."""
    return [F.pmod(F.floor(id_col / mesh.n ** (mesh.dim - 1 - d)), F.lit(mesh.n)).cast("int").alias(x) for d, x in enumerate(names)]


def cell_id(mesh: Mesh, names: list[str] | None = None) -> Column:
    out = F.lit(0).cast("long")
    for x in names or mesh.cells:
        out = out * mesh.n + F.col(x)
    return out


def grid(spark: SparkSession, mesh: Mesh) -> DataFrame:
    """All cells: id and index columns."""
    return spark.range(mesh.size).select("id", *index_columns(F.col("id"), mesh, mesh.cells))


def lagrangian_grid(spark: SparkSession, mesh: Mesh) -> DataFrame:
    """id and the positions qx, qy, qz of a regular lattice of particles."""
    return grid(spark, mesh).select("id", *[(F.col(i) * (mesh.box / mesh.n)).alias(f"q{x}") for i, x in zip(mesh.cells, AXES)])


def signed(j: Column, n: int) -> Column:
    """Mode number -n/2 .. n/2 - 1 of a transform index."""
    return F.when(j < n // 2, j).otherwise(j - n)


def wave_numbers(mesh: Mesh) -> list[Column]:
    return [signed(F.col(j), mesh.n) * F.lit(mesh.fundamental) for j in mesh.modes]


def wave_square(mesh: Mesh) -> Column:
    return sum((k * k for k in wave_numbers(mesh)[1:]), wave_numbers(mesh)[0] * wave_numbers(mesh)[0])


def fourier_grid(spark: SparkSession, mesh: Mesh, full: bool = False) -> DataFrame:
    """id, mode indices, kx, ky, kz and k; the half spectrum unless full."""
    out = spark.range(mesh.size).select("id", *index_columns(F.col("id"), mesh, mesh.modes))
    if not full:
        out = out.where(F.col(mesh.modes[-1]) <= mesh.n // 2)
    ks = [k.alias(f"k{x}") for k, x in zip(wave_numbers(mesh), AXES)]
    return out.select("id", *mesh.modes, *ks, F.sqrt(wave_square(mesh)).alias("k"))


def half(spectrum: DataFrame, mesh: Mesh) -> DataFrame:
    return spectrum.where(F.col(mesh.modes[-1]) <= mesh.n // 2)


def multiplicity(mesh: Mesh) -> Column:
    """How many modes a row of the half spectrum stands for."""
    last = F.col(mesh.modes[-1])
    return F.when((last > 0) & (last < mesh.n // 2), 2).otherwise(1)


def spherical(spectrum: DataFrame, mesh: Mesh) -> DataFrame:
    """Modes beyond the Nyquist sphere set to zero."""
    inside = wave_square(mesh) <= mesh.nyquist**2 * (1 + 1e-12)
    return spectrum.withColumn("re", F.when(inside, F.col("re")).otherwise(0.0)).withColumn("im", F.when(inside, F.col("im")).otherwise(0.0))


# --- projections ------------------------------------------------------------------------------------------------------


def wrap(x: Column, box: float) -> Column:
    """Into [0, box); a value that rounds up to the box is its beginning."""
    out = F.pmod(x, F.lit(float(box)))
    return F.when(out >= box, 0.0).otherwise(out)


def nearest_image(d: Column, box: float) -> Column:
    """A difference as its shortest periodic image, in [-box/2, box/2)."""
    return F.pmod(d + box / 2, F.lit(float(box))) - box / 2


def distance(a: list[Column], b: list[Column], box: float) -> Column:
    parts = [nearest_image(x - y, box) for x, y in zip(a, b)]
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def to_cells(x: Column, mesh: Mesh) -> Column:
    return wrap(x, mesh.box) * (mesh.n / mesh.box)


def to_box(x: Column, mesh: Mesh) -> Column:
    return x * (mesh.box / mesh.n)


def positions_from_displacement(psi: DataFrame, mesh: Mesh, wrapped: bool = True) -> DataFrame:
    """id, x, y, z from id, sx, sy, sz: the lattice position follows from the id, so no join is needed."""
    cell = index_columns(F.col("id"), mesh, mesh.cells)
    at = [c * (mesh.box / mesh.n) + F.col(f"s{x}") for c, x in zip(cell, AXES)]
    return psi.select("id", *[(wrap(p, mesh.box) if wrapped else p).alias(x) for p, x in zip(at, AXES)])


def with_value_at(df: DataFrame, column: str, where: Column, value, add: bool = False) -> DataFrame:
    """Set, or add to, a column at the rows of a condition: single cells, rows and columns of a mesh, or the zero mode."""
    new = F.col(column) + value if add else F.lit(value)
    return df.withColumn(column, F.when(where, new).otherwise(F.col(column)))


def crop(spectrum: DataFrame, small: Mesh, large: Mesh, values: tuple[str, ...] = ("re", "im")) -> DataFrame:
    """Modes of the small mesh from a spectrum of the large one, scaled; the small Nyquist modes are dropped."""
    scale = (small.n / large.n) ** small.dim
    kept = spectrum
    for j in small.modes:
        kept = kept.where(F.abs(signed(F.col(j), large.n)) < small.n // 2)
    index = [F.pmod(signed(F.col(j), large.n), F.lit(small.n)).cast("int").alias(j) for j in small.modes]
    return kept.select(*index, *[(F.col(v) * scale).alias(v) for v in values])


def pad(spectrum: DataFrame, small: Mesh, large: Mesh, values: tuple[str, ...] = ("re", "im"), keep_mean: bool = False) -> DataFrame:
    """The spectrum on a larger mesh, scaled; added modes are absent rows. Nyquist modes are dropped and, in two and three dimensions, the mean unless it is kept."""
    scale = (large.n / small.n) ** small.dim
    kept = spectrum
    for j in small.modes:
        kept = kept.where(F.col(j) != small.n // 2)
    if small.dim > 1 and not keep_mean:
        kept = kept.where(sum((F.col(j) for j in small.modes[1:]), F.col(small.modes[0])) > 0)
    index = [F.pmod(signed(F.col(j), small.n), F.lit(large.n)).cast("int").alias(j) for j in small.modes]
    return kept.select(*index, *[(F.col(v) * scale).alias(v) for v in values])


def completed(df: DataFrame, mesh: Mesh, values: tuple[str, ...] = ("v",)) -> DataFrame:
    """All cells, with zero where the frame has no row."""
    cells = grid(df.sparkSession, mesh).select(*mesh.cells)
    return cells.join(df, mesh.cells, "left").select(*mesh.cells, *[F.coalesce(F.col(v), F.lit(0.0)).alias(v) for v in values])


# --- slices and subsampling -------------------------------------------------------------------------------------------

Span = None | int | tuple[int, int]


def spans(mesh: Mesh, fixed: tuple[Span, ...]) -> list[tuple[int, int] | None]:
    """For each axis None or a half-open range of cells."""
    out = []
    for f in (*fixed, *[None] * (mesh.dim - len(fixed))):
        low, high = (None, None) if f is None else (f, f + 1) if isinstance(f, int) else f
        if f is not None and not 0 <= low < high <= mesh.n:
            raise ValueError(f"no cells {f} in a mesh of {mesh.n}")
        out.append(None if f is None else (low, high))
    return out


def near_slice(particles: DataFrame, mesh: Mesh, fixed: tuple[Span, ...], margin: float) -> DataFrame:
    """Particles within margin of the slice in every fixed axis, as ranges that reach the Parquet scan; stored positions lie in [0, box)."""
    out = particles
    for x, s in zip(AXES, spans(mesh, fixed)):
        if s is None:
            continue
        width = mesh.box / mesh.n
        low, high = s[0] * width - margin, (s[1] - 1) * width + margin
        if high - low >= mesh.box:
            continue
        c = F.col(x)
        keep = (c >= low) & (c <= high)
        if low < 0:
            keep = keep | (c >= low + mesh.box)
        if high >= mesh.box:
            keep = keep | (c <= high - mesh.box)
        out = out.where(keep)
    return out


def cut(field: DataFrame, mesh: Mesh, fixed: tuple[Span, ...], squeeze: bool = True) -> DataFrame:
    """Cells of a slice with indices from 0; axes fixed to one cell are dropped if squeezed."""
    out = field
    for i, s, f in zip(mesh.cells, spans(mesh, fixed), (*fixed, *[None] * mesh.dim)):
        if s is not None:
            out = out.where((F.col(i) >= s[0]) & (F.col(i) < s[1])).withColumn(i, F.col(i) - s[0])
            if squeeze and isinstance(f, int):
                out = out.drop(i)
    return out


def detile(ids: Column, blocks: int, side: int) -> Column:
    """Row-major lattice id of a particle numbered block by block: blocks^3 glass tiles of side^3 each."""
    inner, outer = F.pmod(ids, F.lit(side**3)), F.floor(ids / side**3)
    n, out = blocks * side, F.lit(0).cast("long")
    for d in range(3):
        b = F.pmod(F.floor(outer / blocks ** (2 - d)), F.lit(blocks))
        s = F.pmod(F.floor(inner / side ** (2 - d)), F.lit(side))
        out = out * n + b * side + s
    return out.cast("long")


def stride(df: DataFrame, mesh: Mesh, step: int) -> DataFrame:
    """Every step-th lattice point of every axis, renumbered."""
    names = ["__" + i for i in mesh.cells]
    out = df.select("*", *[c.alias(n) for c, n in zip(index_columns(F.col("id"), mesh, mesh.cells), names)])
    for n in names:
        out = out.where(F.col(n) % step == 0)
    new = F.lit(0).cast("long")
    for n in names:
        new = new * (mesh.n // step) + F.floor(F.col(n) / step)
    return out.withColumn("id", new.cast("long")).drop(*names)


def every_snapshot(df: DataFrame, step: int, snap: str = "snap") -> DataFrame:
    """Every step-th snapshot in the order of their numbers."""
    ranks = df.select(snap).distinct()
    from pyspark.sql.window import Window

    kept = ranks.withColumn("__r", F.row_number().over(Window.orderBy(snap)) - 1).where(F.col("__r") % step == 0).drop("__r")
    return df.join(kept, snap, "left_semi")


def dilated(mask: DataFrame, mesh: Mesh, flag: str = "v") -> DataFrame:
    """Cells within one cell, diagonals included, of a marked one; rolling is periodic."""
    out = mask.where(F.col(flag))
    for i in mesh.cells:
        out = out.withColumn(i, F.explode(F.array(*[F.pmod(F.col(i) + s, F.lit(mesh.n)).cast("int") for s in (-1, 0, 1)])))
    return out.select(*mesh.cells).distinct()
