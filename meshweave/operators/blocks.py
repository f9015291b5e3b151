"""Deposit and gather on meshes beyond a broadcast: by blocks of cells with a margin of ghost cells.

Stencils are summed inside a task and never become rows. For a deposit the particles are sorted into ranges of blocks; a
task adds each run of one block into a small array and sends its occupied cells, so what is exchanged is the particles
once and then at most the cells and ghost cells of each task's blocks. For a gather the mesh becomes one row a block,
with its margin, and the particles one row for some ten thousand of a block; the two meet by the block's number. A block
that holds any share of the particles is dealt among as many tasks as it needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mesh import Mesh, to_cells

SIDE, MARGIN, MOST = 32, 2, 1 << 16
#: Offsets of the cells that an order touches.
TOUCHED = {1: (0,), 2: (0, 1), 3: (-1, 0, 1), 4: (-1, 0, 1, 2)}


def share(d: np.ndarray, order: int) -> np.ndarray:
    """Share of a cell at a distance in cells."""
    return {
        1: lambda: np.ones_like(d), 2: lambda: np.maximum(1 - d, 0), 3: lambda: np.where(d <= 0.5, 0.75 - d * d, np.maximum(1.5 - d, 0) ** 2 / 2),
        4: lambda: np.where(d <= 1, 2 / 3 - d * d * (1 - d / 2), np.maximum(2 - d, 0) ** 3 / 6),
    }[order]()


def slope(d: np.ndarray, order: int) -> np.ndarray:
    """Derivative of the share by the distance."""
    return {
        1: lambda: np.zeros_like(d), 2: lambda: np.where(d <= 1, -1.0, 0.0), 3: lambda: np.where(d <= 0.5, -2 * d, np.minimum(d - 1.5, 0)),
        4: lambda: np.where(d <= 1, d * (1.5 * d - 2), -(np.maximum(2 - d, 0) ** 2) / 2),
    }[order]()


def sides(mesh: Mesh) -> int:
    """Blocks along an axis."""
    return -(-mesh.n // SIDE)


def block_of(cells: list[Column], mesh: Mesh) -> Column:
    out = F.lit(0).cast("long")
    for c in cells:
        out = out * sides(mesh) + F.floor(c / SIDE)
    return out


def placed(particles: DataFrame, mesh: Mesh, order: int, kept: list[Column]) -> DataFrame:
    """Particles that have a place, with their block and their places in cells g*; the block is that of the stencil's base cell."""
    at = particles.where(" AND ".join(f"{x} IS NOT NULL" for x in mesh.places)).select(*kept, *[to_cells(F.col(x), mesh).alias(f"__g{x}") for x in mesh.places])
    base = [F.pmod((F.floor(f"__g{x}") if order % 2 == 0 else F.rint(f"__g{x}")).cast("long"), F.lit(mesh.n)) for x in mesh.places]
    return at.withColumn("__block", block_of(base, mesh))


def stencils(g: np.ndarray, block: int, mesh: Mesh, order: int, slopes: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """For each cell of the stencil: the place in the block's array with margin, the shares and, if asked, their derivatives by position."""
    d, wide = mesh.dim, SIDE + 2 * MARGIN
    origin = np.array(np.unravel_index(block, (sides(mesh),) * d)) * SIDE
    base = np.floor(g) if order % 2 == 0 else np.rint(g)
    local = np.mod(base, mesh.n).astype(np.int64) - origin + MARGIN
    for offsets in product(TOUCHED[order], repeat=d):
        away = g - base - np.array(offsets)
        shares = [share(np.abs(away[:, a]), order) for a in range(d)]
        at = np.zeros(len(g), np.int64)
        for a in range(d):
            at = at * wide + local[:, a] + offsets[a]
        more = []
        if slopes:
            for a in range(d):
                part = np.sign(away[:, a]) * slope(np.abs(away[:, a]), order) * (mesh.n / mesh.box)
                more.append(part * np.prod([shares[b] for b in range(d) if b != a], axis=0) if d > 1 else part)
        yield at, np.prod(shares, axis=0), more


def deposit_by_block(particles: DataFrame, mesh: Mesh, order: int, sums: dict[str, Column]) -> DataFrame:
    """Sums of shares times quantities on the cells that particles touch."""
    d, names, wide = mesh.dim, list(sums), SIDE + 2 * MARGIN
    rows = placed(particles, mesh, order, [F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"__q{k}") for k, c in enumerate(sums.values())])
    # a block's particles may be any share of all: they are dealt by block and place, so that its range can be divided
    dealt = rows.repartitionByRange("__block", "__gx").sortWithinPartitions("__block")
    schema = pa.schema([*[(c, pa.int32()) for c in mesh.cells], *[(n, pa.float64()) for n in names]])
    count = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros((count, wide**d))

        def told(block: int) -> pa.RecordBatch:
            at = np.flatnonzero((total != 0).any(axis=0))
            local = np.stack(np.unravel_index(at, (wide,) * d))
            origin = np.array(np.unravel_index(block, (sides(mesh),) * d)) * SIDE
            cells = np.mod(local - MARGIN + origin[:, None], mesh.n).astype(np.int32)
            out = pa.RecordBatch.from_arrays([*map(pa.array, cells), *(pa.array(t[at]) for t in total)], schema=schema)
            total[:] = 0
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {n: batch.column(n).to_numpy() for n in batch.schema.names}
            blocks, g = columns["__block"], np.stack([columns[f"__g{x}"] for x in mesh.places], axis=1)
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if now is not None and now != blocks[lo]:
                    yield told(now)
                now = int(blocks[lo])
                at, shares, _ = zip(*stencils(g[lo:hi], now, mesh, order), strict=True)
                at = np.concatenate(at)
                for k in range(count):
                    q = columns[f"__q{k}"][lo:hi]
                    total[k] += np.bincount(at, np.concatenate([s * q for s in shares]), wide**d)
        if now is not None:
            yield told(now)

    parts = dealt.mapInArrow(run, ", ".join([*[f"{c} int" for c in mesh.cells], *[f"{n} double" for n in names]]))
    return parts.groupBy(*mesh.cells).agg(*[F.sum(n).alias(n) for n in names])


def gather_by_block(field: DataFrame, particles: DataFrame, mesh: Mesh, order: int, values: tuple[str, ...], gradient: bool = False) -> DataFrame:
    """id, each value at the particles and, if asked, its derivatives d<value>_d<axis>; absent cells are zero."""
    d, n, wide = mesh.dim, sides(mesh), SIDE + 2 * MARGIN
    # each cell goes to its block and, where it lies in their margin, to the neighbours
    cells = field.select(*[F.col(c).cast("int").alias(c) for c in mesh.cells], *[F.col(v).cast("double").alias(f"__{k}") for k, v in enumerate(values)])
    for c in mesh.cells:
        near = [F.pmod(F.col(c) + s, F.lit(mesh.n)) for s in (-MARGIN, 0, MARGIN)]
        cells = cells.withColumn(f"__b{c}", F.explode(F.array_distinct(F.array(*[F.floor(x / SIDE).cast("int") for x in near]))))
        cells = cells.withColumn(f"__l{c}", F.pmod(F.col(c) - F.col(f"__b{c}") * SIDE + MARGIN, F.lit(mesh.n)))
    number, local = F.lit(0).cast("long"), F.lit(0)
    for c in mesh.cells:
        number, local = number * n + F.col(f"__b{c}"), local * wide + F.col(f"__l{c}")
    for c in mesh.cells:
        cells = cells.where(F.col(f"__l{c}") < wide)
    packed = cells.select(number.alias("__block"), F.struct(local.cast("int").alias("at"), *[f"__{k}" for k in range(len(values))]).alias("x")).groupBy("__block").agg(F.collect_list("x").alias("cells"))

    rows = placed(particles, mesh, order, [F.col("id")])
    counts = rows.groupBy("__block").agg(F.ceil(F.count("*") / MOST).cast("int").alias("__parts"))
    dealt = rows.join(counts, "__block").withColumn("__part", F.pmod(F.xxhash64("id"), F.col("__parts")))
    batches_of = dealt.groupBy("__block", "__part").agg(F.collect_list(F.struct("id", *[f"__g{x}" for x in mesh.places])).alias("points"))
    met = batches_of.join(packed, "__block", "left").select("__block", "points", "cells")
    slots = [*values, *([f"d{v}_d{x}" for v in values for x in mesh.places] if gradient else [])]
    id_type = dict(particles.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, points = batch.column(0)[row].as_py(), batch.column(1)[row].values
                grid = np.zeros((len(values), wide**d))
                if batch.column(2)[row].is_valid:
                    known = batch.column(2)[row].values
                    at = known.field("at").to_numpy()
                    for k in range(len(values)):
                        grid[k, at] = np.nan_to_num(known.field(f"__{k}").to_numpy(zero_copy_only=False))
                g = np.stack([points.field(f"__g{x}").to_numpy() for x in mesh.places], axis=1)
                out = np.zeros((len(slots), len(g)))
                for at, shares, more in stencils(g, block, mesh, order, gradient):
                    for k in range(len(values)):
                        here = grid[k, at]
                        out[k] += shares * here
                        for a, m in enumerate(more):
                            out[len(values) + k * d + a] += m * here
                yield pa.RecordBatch.from_arrays([points.field("id"), *map(pa.array, out)], names=["id", *slots])

    return met.mapInArrow(run, ", ".join([f"id {id_type}", *[f"`{s}` double" for s in slots]]))
