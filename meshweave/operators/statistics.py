"""Summary statistics: power and cross spectra, bispectra, Jacobians."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fourier import forward, full_from_half, gradient_kernel, real_forward, transform
from .mesh import Mesh, multiplicity, signed, wave_square


def bin_edges(mesh: Mesh, bins: int | tuple[float, ...], logarithmic: bool = True) -> list[float]:
    """Edges of wave-number bins: given, or that many between the fundamental and the Nyquist mode with half a bin around."""
    if not isinstance(bins, int):
        if any(b <= a for a, b in zip(bins, bins[1:])) or bins[0] < 0:
            raise ValueError("edges must increase")
        return list(bins)
    low, high = mesh.fundamental, mesh.nyquist
    if logarithmic:
        step = (math.log(high) - math.log(low)) / (bins - 1)
        return [math.exp(math.log(low) + (n - 0.5) * step) for n in range(bins + 1)]
    step = (high - low) / (bins - 1)
    return [low + (n - 0.5) * step for n in range(bins + 1)]


def bin_of(k: Column, edges: list[float]) -> Column:
    """Index of the left-closed bin of k, null outside."""
    rank = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= k)) - 1
    return F.when((k >= edges[0]) & (k < edges[-1]), rank)


def power_spectrum(field: DataFrame, mesh: Mesh, bins: int | tuple[float, ...] = 8, logarithmic: bool = True, deviation: bool = False) -> DataFrame:
    """bin, modes, k (mean over the modes), pk and, if asked, its standard deviation over independent modes."""
    spectrum = real_forward(field, mesh)
    return binned(spectrum.withColumn("p", F.col("re") * F.col("re") + F.col("im") * F.col("im")), mesh, bins, logarithmic, deviation)


def binned(spectrum: DataFrame, mesh: Mesh, bins: int | tuple[float, ...], logarithmic: bool = True, deviation: bool = False) -> DataFrame:
    norm = mesh.box**mesh.dim / mesh.size**2
    rows = spectrum.withColumn("__k", F.sqrt(wave_square(mesh))).withColumn("__m", multiplicity(mesh)).withColumn("bin", bin_of(F.col("__k"), bin_edges(mesh, bins, logarithmic))).where("bin IS NOT NULL")
    m, p = F.col("__m"), F.col("p") * norm
    out = rows.groupBy("bin").agg(F.sum(m).alias("modes"), (F.sum(m * F.col("__k")) / F.sum(m)).alias("k"), (F.sum(m * p) / F.sum(m)).alias("pk"), F.sum(m * p * p).alias("__pp"))
    if deviation:
        spread = F.greatest(F.lit(0.0), F.col("__pp") - F.col("modes") * F.col("pk") * F.col("pk"))
        out = out.withColumn("sd", F.sqrt(F.try_divide(spread, F.col("modes") - 1)))
    return out.drop("__pp").withColumn("bin", F.col("bin").cast("int"))


def cross_spectrum(a: DataFrame, b: DataFrame, mesh: Mesh, bins: int | tuple[float, ...] = 8, logarithmic: bool = True) -> DataFrame:
    """bin, k, p1, p2 and the normalised cross spectrum x: one join by mode and one aggregate of three sums."""
    fa, fb = real_forward(a, mesh), real_forward(b, mesh).select(*mesh.modes, F.col("re").alias("__r"), F.col("im").alias("__i"))
    norm = mesh.box**mesh.dim / mesh.size**2
    rows = fa.join(fb, mesh.modes).withColumn("__k", F.sqrt(wave_square(mesh))).withColumn("__m", multiplicity(mesh)).withColumn("bin", bin_of(F.col("__k"), bin_edges(mesh, bins, logarithmic))).where("bin IS NOT NULL")
    m = F.col("__m")
    mean = lambda x: F.sum(m * x) / F.sum(m) * norm
    out = rows.groupBy("bin").agg((F.sum(m * F.col("__k")) / F.sum(m)).alias("k"), mean(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("p1"), mean(F.col("__r") * F.col("__r") + F.col("__i") * F.col("__i")).alias("p2"), mean(F.col("re") * F.col("__r") + F.col("im") * F.col("__i")).alias("__x"))
    return out.select(F.col("bin").cast("int").alias("bin"), "k", "p1", "p2", F.try_divide("__x", F.sqrt(F.col("p1") * F.col("p2"))).alias("x"))


def triangles(mesh: Mesh, bins: int, equilateral: bool = False) -> list[tuple[int, int, int]]:
    """Bin triples k1 >= k2 >= k3 that close, over linear bins from the fundamental to n/3 of it."""
    edges = bispectrum_edges(mesh, bins)
    c, w = [(a + b) / 2 for a, b in zip(edges, edges[1:])], (edges[1] - edges[0]) / 2
    if equilateral:
        return [(n, n, n) for n in range(bins)]
    return [(i, j, l) for i in range(bins) for j in range(i + 1) for l in range(j + 1) if c[i] - w < c[j] + c[l] + 2 * w]


def bispectrum_edges(mesh: Mesh, bins: int) -> list[float]:
    top = mesh.n / 3 * mesh.fundamental
    return [mesh.fundamental + n * (top - mesh.fundamental) / bins for n in range(bins + 1)]


def bispectrum(field: DataFrame, mesh: Mesh, bins: int = 3, equilateral: bool = False, only_b: bool = False, direct: bool = False) -> DataFrame:
    """b1, b2, b3, k1, k2, k3, triangles and b for every closed triple of shells; only_b leaves out all but the shells and b.

    direct: the sum over closed triangles of modes, for few modes; otherwise by transforms: the field and the count of modes, each filtered to a shell, go back to real space in one pass of many columns;
    a triple is then a sum over cells of products in the same row.
    """
    edges = bispectrum_edges(mesh, bins)
    if direct:
        centre = F.array(*[F.lit((a + b) / 2) for a, b in zip(edges, edges[1:])])
        told = field.sparkSession.createDataFrame(triangles(mesh, bins, equilateral), "b1 int, b2 int, b3 int")  # some bins cubed
        out = told.join(closed_triangles(field, mesh, edges), ["b1", "b2", "b3"], "left").select("b1", "b2", "b3", *[F.get(centre, F.col(f"b{n}")).alias(f"k{n}") for n in (1, 2, 3)], F.coalesce("triangles", F.lit(0)).cast("long").alias("triangles"), "b")
        return out.select("b1", "b2", "b3", "b") if only_b else out
    shell = F.sqrt(wave_square(mesh))
    columns, pairs = [], []
    spectrum = forward(field, mesh).withColumn("__k", shell)
    for n in range(bins):
        inside = (F.col("__k") >= edges[n]) & (F.col("__k") < edges[n + 1])
        columns += [F.when(inside, F.col("re")).otherwise(0.0).alias(f"d{n}"), F.when(inside, F.col("im")).otherwise(0.0).alias(f"e{n}"), F.when(inside, 1.0).otherwise(0.0).alias(f"c{n}"), F.lit(0.0).alias(f"z{n}")]
        pairs += [(f"d{n}", f"e{n}"), (f"c{n}", f"z{n}")]
    cells = transform(spectrum.select(*mesh.modes, *columns), mesh, tuple(pairs), inverse=True, method="slab")
    triples = triangles(mesh, bins, equilateral)
    product = lambda p, t: F.sum(F.col(f"{p}{t[0]}") * F.col(f"{p}{t[1]}") * F.col(f"{p}{t[2]}"))
    sums = cells.agg(F.array(*[F.struct(*[F.lit(x).alias(f"b{n + 1}") for n, x in enumerate(t)], product("d", t).alias("s"), product("c", t).alias("t")) for t in triples]).alias("all"))
    centre = F.array(*[F.lit((a + b) / 2) for a, b in zip(edges, edges[1:])])
    out = sums.select(F.inline("all"))
    # N^2d sum of the counts' product is the number of triangles; b = V^2 / N^3d times the mean product of modes
    count = F.col("t") * mesh.size**2
    mean = F.try_divide("s", "t") * (mesh.box ** (2 * mesh.dim) / mesh.size**3)
    if only_b:
        return out.select("b1", "b2", "b3", mean.alias("b"))
    return out.select("b1", "b2", "b3", *[F.get(centre, F.col(f"b{n}")).alias(f"k{n}") for n in (1, 2, 3)], F.round(count).cast("long").alias("triangles"), mean.alias("b"))


def closed_triangles(field: DataFrame, mesh: Mesh, edges: list[float], block: int = 2048) -> DataFrame:
    """b1 >= b2 >= b3, triangles and b from all triples of modes that add up to zero, one mode in each shell.

    Every triangle is met once: its modes are ordered by shell and number, a mode and its mirror having one number, and
    the first is the positive of the two; orders of equal shells and the mirrored triangle are counted by a factor. Two
    modes meet by the block of the second, and the third is looked up by what closes the triangle.
    """
    d, n = mesh.dim, mesh.n
    k = [f"k{a}" for a in range(d)]
    modes = full_from_half(real_forward(field, mesh), mesh).withColumn("s", bin_of(F.sqrt(wave_square(mesh)), edges)).where("s IS NOT NULL")
    modes = modes.select("s", *[signed(F.col(j), n).cast("long").alias(c) for j, c in zip(mesh.modes, k)], "re", "im")
    number = F.lit(0).cast("long")
    for c in k:
        number = number * (2 * n) + F.col(c)
    modes = modes.select("*", F.abs(number).alias("m"), (number > 0).alias("up")).checkpoint()
    parts = 1 + modes.count() // block
    named = lambda p: modes.select(*[F.col(c).alias(p + c) for c in ("s", *k, "re", "im", "m", "up")])
    a = named("a").where("aup").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    b = named("b").withColumn("part", F.pmod(F.xxhash64("bm", "bup"), F.lit(parts)).cast("int"))
    after = lambda p, q: (F.col(p + "s") > F.col(q + "s")) | ((F.col(p + "s") == F.col(q + "s")) & ((F.col(p + "m") > F.col(q + "m")) | ((F.col(p + "m") == F.col(q + "m")) & (F.col(p + "up") == F.col(q + "up")))))
    pairs = a.join(b, "part").where(after("a", "b")).withColumns({"c" + c: -(F.col("a" + c) + F.col("b" + c)) for c in k})
    met = pairs.join(named("c"), [f"c{c}" for c in k]).where(after("b", "c"))
    same = lambda p, q: (F.col(p + "m") == F.col(q + "m")) & (F.col(p + "up") == F.col(q + "up"))
    alike = lambda p, q: F.col(p + "s") == F.col(q + "s")
    twins = same("a", "b") | same("b", "c")
    orders = F.when(alike("a", "b") & alike("b", "c"), F.when(twins, 3).otherwise(6)).when(alike("a", "b"), F.when(same("a", "b"), 1).otherwise(2)).when(alike("b", "c"), F.when(same("b", "c"), 1).otherwise(2)).otherwise(1)
    product = F.col("are") * (F.col("bre") * F.col("cre") - F.col("bim") * F.col("cim")) - F.col("aim") * (F.col("bre") * F.col("cim") + F.col("bim") * F.col("cre"))
    sums = met.select(*[F.col(p + "s").cast("int").alias(f"b{i + 1}") for i, p in enumerate("abc")], (2 * orders).alias("w"), product.alias("p"))
    return sums.groupBy("b1", "b2", "b3").agg(F.sum("w").cast("long").alias("triangles"), (F.sum(F.col("w") * F.col("p")) / F.sum("w") * (mesh.box ** (2 * d) / mesh.size**3)).alias("b"))


def jacobian(psi: DataFrame, mesh: Mesh, order: int = 0, values: bool = False) -> DataFrame:
    """Cells with the matrix d x / d q (m00 ...), its determinant and, if asked, its eigenvalues e0 <= e1 <= e2 of the symmetric part."""
    d, names = mesh.dim, [f"s{x}" for x in ("x", "y", "z")[: mesh.dim]]
    field = psi.select(*mesh.cells, *[c for s in names for c in (F.col(s).alias(f"__r{s}"), F.lit(0.0).alias(f"__i{s}"))])
    spectrum = transform(field, mesh, tuple((f"__r{s}", f"__i{s}") for s in names), method="slab")
    cols, pairs = [], []
    for a, s in enumerate(names):
        for b in range(d):
            k = gradient_kernel(mesh, b, order)
            cols += [(-F.col(f"__i{s}") * k).alias(f"m{a}{b}"), (F.col(f"__r{s}") * k).alias(f"__m{a}{b}")]
            pairs.append((f"m{a}{b}", f"__m{a}{b}"))
    cells = transform(spectrum.select(*mesh.modes, *cols), mesh, tuple(pairs), inverse=True, method="slab")
    m = [[F.col(f"m{a}{b}") + (1.0 if a == b else 0.0) for b in range(d)] for a in range(d)]
    out = cells.select(*mesh.cells, *[m[a][b].alias(f"m{a}{b}") for a in range(d) for b in range(d)])
    c = lambda a, b: F.col(f"m{a}{b}")
    if d == 1:
        det = c(0, 0)
    elif d == 2:
        det = c(0, 0) * c(1, 1) - c(0, 1) * c(1, 0)
    else:
        minor = lambda i, j: c(1, i) * c(2, j) - c(1, j) * c(2, i)
        det = c(0, 0) * minor(1, 2) - c(0, 1) * minor(0, 2) + c(0, 2) * minor(0, 1)
    out = out.withColumn("det", det)
    return eigenvalues(out, d) if values else out


def eigenvalues(df: DataFrame, dim: int) -> DataFrame:
    """Eigenvalues of the symmetric part of m00 ..., ascending, in closed form."""
    c = lambda a, b: (F.col(f"m{a}{b}") + F.col(f"m{b}{a}")) / 2
    if dim == 1:
        return df.withColumn("e0", c(0, 0))
    if dim == 2:
        mid, gap = (c(0, 0) + c(1, 1)) / 2, F.sqrt(F.pow((c(0, 0) - c(1, 1)) / 2, 2) + F.pow(c(0, 1), 2))
        return df.withColumn("e0", mid - gap).withColumn("e1", mid + gap)
    q = (c(0, 0) + c(1, 1) + c(2, 2)) / 3
    off = c(0, 1) ** 2 + c(0, 2) ** 2 + c(1, 2) ** 2
    df = df.withColumn("__q", q).withColumn("__p", F.sqrt(((c(0, 0) - q) ** 2 + (c(1, 1) - q) ** 2 + (c(2, 2) - q) ** 2 + 2 * off) / 6))
    b = lambda i, j: F.try_divide(c(i, j) - (F.col("__q") if i == j else 0.0), F.col("__p"))
    det = b(0, 0) * (b(1, 1) * b(2, 2) - b(1, 2) * b(1, 2)) - b(0, 1) * (b(0, 1) * b(2, 2) - b(1, 2) * b(0, 2)) + b(0, 2) * (b(0, 1) * b(1, 2) - b(1, 1) * b(0, 2))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(det, F.lit(0.0)) / 2))) / 3
    df = df.withColumn("__a", angle)
    out = df.withColumn("e2", F.col("__q") + 2 * F.col("__p") * F.cos("__a")).withColumn("e0", F.col("__q") + 2 * F.col("__p") * F.cos(F.col("__a") + 2 * math.pi / 3))
    return out.withColumn("e1", 3 * F.col("__q") - F.col("e0") - F.col("e2")).drop("__q", "__p", "__a")


def rescaled(field: DataFrame, deviation: float, value: str = "v") -> DataFrame:
    """The field scaled to a standard deviation."""
    spread = field.agg(F.stddev_pop(value).alias("__s"))
    return field.join(F.broadcast(spread), how="cross").withColumn(value, F.col(value) * deviation / F.col("__s")).drop("__s")
