"""White noise of the N-GenIC kind: one RANLXD stream for each pair of the first two mode indices.

The generator is Luscher's RANLUX in double precision (hep-lat/9309020) at the first luxury level. The seed table has
a stream's seed for every (i, j), filled in square shells around each corner of the plane, so that a finer mesh keeps
the coarse modes. No reference vector is at hand, so parity with published realisations is not verified.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fourier import backward, full_from_half
from ..operators.mesh import Mesh

BASE = 1 << 48


class Ranlxd:
    """Subtract-with-borrow modulo 2^48 with lags 12 and 7, of which pr of every pr + 12 numbers are skipped."""

    def __init__(self, seed: int, skip: int = 202):
        bits, state = [], max(1, seed)
        for _ in range(31):
            bits.append(state % 2)
            state //= 2
        n, m = 0, 18
        self.x = []
        for _ in range(12):
            v = 0
            for _ in range(48):
                v = 2 * v + (bits[n] + 1) % 2
                bits[n] = (bits[n] + bits[m]) % 2
                n, m = (n + 1) % 31, (m + 1) % 31
            self.x.append(v)
        self.carry, self.r, self.s, self.skip, self.left = 0, 0, 7, skip, 0

    def step(self) -> int:
        d = self.x[self.s] - self.x[self.r] - self.carry
        self.carry = int(d < 0)
        self.x[self.r] = d % BASE
        out = self.x[self.r]
        self.r, self.s = (self.r + 1) % 12, (self.s + 1) % 12
        return out

    def uniform(self) -> float:
        if not self.left:
            for _ in range(self.skip - 12):
                self.step()
            self.left = 12
        self.left -= 1
        return self.step() / BASE


def seed_table(n: int, seed: int) -> np.ndarray:
    """Seeds of the streams of all (i, j), drawn in growing squares from the four corners."""
    rng, out, half = Ranlxd(seed), np.zeros((n, n), dtype=np.int64), n // 2
    draw = lambda: int(0x7FFFFFFF * rng.uniform())
    for i in range(half):
        for mirror_x, mirror_y in ((0, 0), (1, 0), (0, 1), (1, 1)):
            x = lambda k: n - 1 - k if mirror_x else k  # noqa: E731, B023
            y = lambda k: n - 1 - k if mirror_y else k  # noqa: E731, B023
            for j in range(i):
                out[x(i), y(j)] = draw()
            for j in range(i + 1):
                out[x(j), y(i)] = draw()
    return out


def ngenic_noise(spark: SparkSession, mesh: Mesh, seed: int) -> DataFrame:
    """jx, jy, jz, re, im: half spectrum of unit Gaussian modes of a real field; a task draws the streams of its rows (i, j).

    The mean and all modes with a Nyquist index are zero, so they have no rows. In the plane jz = 0 the half with
    0 < i < n/2, or i = 0 and j < n/2, is drawn and the other half holds the conjugates.
    """
    n = mesh.n
    if mesh.dim != 3:
        raise ValueError("three dimensions")
    seeds, half = seed_table(n, seed), n // 2
    rows = spark.createDataFrame([(i, j, int(seeds[i, j])) for i in range(n) for j in range(n) if half not in (i, j)], "jx int, jy int, seed long")

    def draw(parts):
        for pdf in parts:
            out = []
            for i, j, s in pdf.itertuples(index=False):
                rng = Ranlxd(int(s))
                for k in range(half):
                    phase = 2 * math.pi * rng.uniform()
                    u = rng.uniform()
                    while u == 0:
                        u = rng.uniform()
                    r = math.sqrt(-math.log(u))
                    re, im = r * math.cos(phase), r * math.sin(phase)
                    if k:
                        out.append((i, j, k, re, im))
                    elif 0 < i < half or i == 0 < j < half:
                        out += [(i, j, 0, re, im), (-i % n, -j % n, 0, re, -im)]
            yield pd.DataFrame(out, columns=["jx", "jy", "jz", "re", "im"])

    drawn = rows.repartition(max(1, n * n // 256)).mapInPandas(draw, "jx int, jy int, jz int, re double, im double")
    scale = math.sqrt(mesh.size)
    return drawn.select(*mesh.modes, (F.col("re") * scale).alias("re"), (F.col("im") * scale).alias("im"))


def ngenic_field(spark: SparkSession, mesh: Mesh, seeds: int | Sequence[int]) -> DataFrame:
    """The white-noise field v on every cell; of several seeds one field each, told apart by the column seed."""
    if isinstance(seeds, int):
        return backward(full_from_half(ngenic_noise(spark, mesh, seeds), mesh), mesh)
    return reduce(DataFrame.unionByName, [ngenic_field(spark, mesh, s).withColumn("seed", F.lit(s).cast("long")) for s in seeds])
