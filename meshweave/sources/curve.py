"""Particles stored along a space-filling curve, and slices, skewers and boxes read as intervals of it.

The table is sorted by Morton key and divided into folders by the key's first bits. A box of any shape is covered by a
bounded number of key intervals: the folders that no interval meets are not listed, row groups that none meets are
skipped by their statistics, and what is read is filtered by the exact places. Boxes may reach over the periodic edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mesh import Mesh, Span, spans, wrap
from ..operators.octree import shifted_right
from ..operators.tree_keys import keyed

BITS = {1: 20, 2: 16, 3: 12}
Range = tuple[float, float] | None


def write_sorted(particles: DataFrame, mesh: Mesh, path: str, level: int = 2, ranges: int | None = None) -> None:
    """The particles with wrapped places, their key (morton) and folder (cell, the key's bits down to a level), sorted by key; those without a place are left out."""
    bits = BITS[mesh.dim]
    there = particles.where(" AND ".join(f"{x} IS NOT NULL" for x in mesh.places)).withColumns({x: wrap(F.col(x), mesh.box) for x in mesh.places})
    rows = keyed(there, mesh, bits).withColumn("cell", shifted_right("morton", str(mesh.dim * (bits - level))))
    n = ranges or int(particles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(n, "morton").sortWithinPartitions("cell", "morton").write.partitionBy("cell").parquet(path)


def pieces(low: float, high: float, box: float) -> list[tuple[float, float]]:
    """A half-open range as ranges inside the box: one, or two over the edge."""
    if high - low >= box:
        return [(0.0, box)]
    low, high = low % box, high % box
    if low == high:
        return []
    return [(low, high)] if low < high else [x for x in ((low, box), (0.0, high)) if x[0] < x[1]]


def intervals(mesh: Mesh, box: list[list[tuple[float, float]]], most: int = 64) -> list[tuple[int, int]]:
    """Key intervals, both ends included, that cover the product of the axes' ranges: nodes are divided, the largest first, while some lie partly outside and there are fewer than most."""
    d, bits = mesh.dim, BITS[mesh.dim]

    def met(prefix: int, level: int) -> int:
        """0 outside, 1 partly inside, 2 inside."""
        size, whole = mesh.box / (1 << level), True
        for a in range(d):
            place = sum(((prefix >> (d * b + d - 1 - a)) & 1) << b for b in range(level))
            lo, hi = place * size, (place + 1) * size
            if not any(x < hi and lo < y for x, y in box[a]):
                return 0
            whole = whole and any(x <= lo and hi <= y for x, y in box[a])
        return 2 if whole else 1

    done, open_nodes = [], [(0, 0)] if met(0, 0) else []
    while open_nodes and len(done) + len(open_nodes) < most and open_nodes[0][0] < bits:
        level, prefix = open_nodes.pop(0)
        if met(prefix, level) == 2:
            done.append((level, prefix))
            continue
        open_nodes += [(level + 1, p) for p in range(prefix << d, (prefix + 1) << d) if met(p, level + 1)]
    ends = sorted((prefix << d * (bits - level), ((prefix + 1) << d * (bits - level)) - 1) for level, prefix in done + open_nodes)
    out: list[tuple[int, int]] = []
    for lo, hi in ends:
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def any_of(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def read_box(spark: SparkSession, path: str, mesh: Mesh, ranges: list[Range], level: int = 2, most: int = 64) -> DataFrame:
    """Particles whose places lie in the half-open range of every axis (None: anywhere)."""
    box = [[(0.0, mesh.box)] if r is None else pieces(*r, mesh.box) for r in ranges]
    rows = spark.read.parquet(path)
    if not all(box):
        return rows.where(F.lit(False)).drop("cell")
    shift = mesh.dim * (BITS[mesh.dim] - level)
    found = intervals(mesh, box, most)
    rows = rows.where(any_of([F.col("cell").between(lo >> shift, hi >> shift) for lo, hi in found])).where(any_of([F.col("morton").between(lo, hi) for lo, hi in found]))
    for x, parts in zip(mesh.places, box, strict=True):
        if parts != [(0.0, mesh.box)]:
            rows = rows.where(any_of([(F.col(x) >= lo) & (F.col(x) < hi) for lo, hi in parts]))
    return rows.drop("cell")


def read_slice(spark: SparkSession, path: str, mesh: Mesh, fixed: tuple[Span, ...], margin: float = 0.0, level: int = 2) -> DataFrame:
    """Particles of a slice or skewer of the mesh's cells, with a margin on both sides."""
    width = mesh.box / mesh.n
    return read_box(spark, path, mesh, [None if s is None else (s[0] * width - margin, s[1] * width + margin) for s in spans(mesh, fixed)], level)
