"""Groups of neighbouring particles of bounded size, and which of them are within reach of each other.

A group is the largest node of the octree (quadtree in two dimensions) that holds at most so many particles; particles
that even the finest cell cannot tell apart are dealt into parts. So no group is larger than the bound wherever the
particles are, and a group has one row with its particles in an array. Groups of any two levels meet by the coarse
cells that they cover, cells at least as wide as the reach.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mesh import Mesh, wrap
from .tree_keys import keyed, unmorton

GROUP = ["level", "prefix", "part"]
#: Tables of groups of at most this many rows are broadcast to the particles.
BROADCAST_GROUPS = 200_000


def shifted_right(key: Column | str, by: str) -> Column:
    """A key without its last bits; by is SQL."""
    return F.expr(f"shiftright({key}, cast({by} AS int))")


def occupied(particles: DataFrame, mesh: Mesh, bits: int, most: int) -> DataFrame:
    """level, prefix, n, parts of every group. particles have their key.

    Cells are counted on a level where most of them should fit; only the particles of those that do not are counted
    again, some levels deeper, until all fit or the finest level is reached. The tables of cells are small.
    """
    d, rows, low, out = mesh.dim, particles.select("morton"), -1, None
    level = min(bits, 1 + math.ceil(math.log2(max(1, rows.count() / most)) / d))
    while True:
        cells = rows.groupBy(shifted_right("morton", str(d * (bits - level))).alias("prefix")).agg(F.count("*").alias("n")).checkpoint()
        nodes = cells.withColumn("level", F.explode(F.sequence(F.lit(max(low, 0)), F.lit(level)))).groupBy("level", shifted_right("prefix", f"{d} * ({level} - level)").alias("prefix")).agg(F.sum("n").alias("n"))
        # the children of a node that is too large, and the root if it is not
        families = nodes.groupBy((F.col("level") - 1).alias("above"), shifted_right("prefix", str(d)).alias("of")).agg(F.sum("n").alias("all"), F.collect_list(F.struct("level", "prefix", "n")).alias("nodes"))
        found = families.where(F.col("above") >= low).where((F.col("all") > most) | (F.col("above") < 0)).select(F.explode("nodes").alias("x")).select("x.*").where((F.col("n") <= most) | (F.col("level") == bits))
        out = found if out is None else out.unionByName(found)
        large = cells.where(F.col("n") > most)
        if level == bits or not (count := large.count()):
            return out.withColumn("parts", F.ceil(F.col("n") / most).cast("int")).checkpoint()
        mark = large.select(F.col("prefix").alias("in"))
        rows = rows.join(F.broadcast(mark) if count <= BROADCAST_GROUPS else mark, shifted_right("morton", str(d * (bits - level))) == F.col("in"), "left_semi")
        low, level = level, min(bits, level + 3)


def grouped(particles: DataFrame, mesh: Mesh, bits: int, most: int) -> tuple[DataFrame, DataFrame]:
    """The groups (one row a part) and the particles in them: level, prefix, part, n and points, an array of id, morton and wrapped places."""
    d, places = mesh.dim, mesh.places
    there = particles.where(" AND ".join(f"{x} IS NOT NULL" for x in places)).select("id", *[wrap(F.col(x), mesh.box).alias(x) for x in places])
    at = keyed(there, mesh, bits)
    groups = occupied(at, mesh, bits, most)
    levels = sorted(r[0] for r in groups.select("level").distinct().collect())  # bits + 1 at most
    small = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
    dealt = at.withColumn("level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))).withColumn("prefix", shifted_right("morton", f"{d} * ({bits} - level)"))
    dealt = dealt.join(small.select("level", "prefix", "parts"), ["level", "prefix"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    packed = dealt.groupBy(*GROUP).agg(F.count("*").alias("n"), F.collect_list(F.struct("id", "morton", *places)).alias("points"))
    return groups.select("level", "prefix", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), packed


def corner(mesh: Mesh, level: str = "level", prefix: str = "prefix", bits: int = 20) -> list[Column]:
    """Integer place of a node on its own level."""
    return unmorton(F.col(prefix), mesh.dim, bits)


def within(groups: DataFrame, mesh: Mesh, reach: float, bits: int) -> DataFrame:
    """Pairs of groups whose cells come within reach: level, prefix, part of the one and o_level, o_prefix, o_part of the other. Every group meets itself."""
    coarse = max(0, min(bits, int(math.floor(math.log2(mesh.box / reach))) if reach < mesh.box else 0))
    n, axes = 1 << coarse, [f"c{x}" for x in mesh.places]
    size = F.lit(float(mesh.box)) / F.pow(F.lit(2.0), F.col("level"))
    placed = groups.select(*GROUP, size.alias("size"), *[u.alias(f"u{x}") for u, x in zip(corner(mesh, bits=bits), mesh.places)])

    def covered(margin: int) -> DataFrame:
        out = placed
        for x, c in zip(mesh.places, axes):
            low = F.when(F.col("level") >= coarse, shifted_right(f"u{x}", f"greatest(level - {coarse}, 0)")).otherwise(F.expr(f"shiftleft(u{x}, cast(greatest({coarse} - level, 0) AS int))"))
            wide = F.expr(f"shiftleft(1L, cast(greatest({coarse} - level, 0) AS int))")
            out = out.withColumn(c, F.explode(F.array_distinct(F.transform(F.sequence(low - margin, low + wide - 1 + margin), lambda v: F.pmod(v, F.lit(n).cast("long"))))))
        return out

    near = covered(1).select(*axes, *GROUP, "size", *[f"u{x}" for x in mesh.places])
    other = covered(0).select(*axes, *[F.col(c).alias(f"o_{c}") for c in (*GROUP, "size", *[f"u{x}" for x in mesh.places])])
    met = near.join(other, axes)
    gaps = []
    for x in mesh.places:
        apart = F.abs((F.col(f"u{x}") + 0.5) * F.col("size") - (F.col(f"o_u{x}") + 0.5) * F.col("o_size"))
        gaps.append(F.greatest(F.lit(0.0), F.least(apart, mesh.box - apart) - (F.col("size") + F.col("o_size")) / 2))
    met = met.where(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]) <= reach**2 * (1 + 1e-12))
    return met.select(*GROUP, *[f"o_{c}" for c in GROUP]).distinct()


class Nodes:
    """The nodes below one group, from its particles in the order of their keys: arrays of level, first and last particle, whether a leaf, first child and number of children, centre and side of the cell."""

    def __init__(self, keys: np.ndarray, level: int, mesh: Mesh, bits: int, leaf: int):
        d = mesh.dim
        self.rows, self.child, self.children = [(level, 0, len(keys))], [], []
        done = 0
        while done < len(self.rows):
            depth, lo, hi = self.rows[done]
            self.child.append(len(self.rows))
            if hi - lo > leaf and depth < bits:
                inner = keys[lo:hi] >> np.int64(d * (bits - depth - 1))
                cuts = np.flatnonzero(inner[1:] != inner[:-1]) + 1 + lo
                self.rows += [(depth + 1, a, b) for a, b in zip([lo, *cuts], [*cuts, hi], strict=True)]
            self.children.append(len(self.rows) - self.child[-1])
            done += 1
        table = np.array(self.rows, np.int64).reshape(-1, 3)
        self.level, self.lo, self.hi = table.T
        self.child, self.children = np.array(self.child), np.array(self.children)
        self.leaf = self.children == 0
        self.side = mesh.box / 2.0**self.level
        prefix = keys[self.lo] >> (d * (bits - self.level))
        self.middle = (np.stack([self._axis(prefix, d, a, bits) for a in range(d)], axis=1) + 0.5) * self.side[:, None]

    @staticmethod
    def _axis(prefix: np.ndarray, d: int, axis: int, bits: int) -> np.ndarray:
        out = np.zeros(len(prefix), np.int64)
        for b in range(bits):
            out |= ((prefix >> (d * b + d - 1 - axis)) & 1) << b
        return out


def apart(a: np.ndarray, b: np.ndarray, box: float) -> np.ndarray:
    """Distances of coordinates on the circle."""
    d = np.abs(a - b)
    return np.minimum(d, box - d)
