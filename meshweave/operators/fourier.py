"""Discrete Fourier transforms of long-form meshes and the kernels applied between them.

Three ways, one convention (forward unscaled, inverse divided by the cells): "sql", axis by axis in plain expressions
for small meshes; "pencil", axis by axis in Arrow groups that hold a bounded set of pencils, for any size; "slab", all
axes but the first in groups of planes and then the first in groups of columns, with one exchange of arrays between
them, for meshes whose planes fit a task (meshes of at most BLOCK_CELLS are one group). Several fields are transformed in
one pass. The spectrum of a real field is half stored: its last index goes from 0 to n/2, the rest are conjugates;
`real_forward` and `real_backward` compute, exchange and keep that half only.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mesh import Mesh, crop, pad, signed, wave_numbers, wave_square

BLOCK_CELLS, SQL_CELLS, GROUP_CELLS = 1 << 15, 4096, 1 << 17
Pairs = tuple[tuple[str, str], ...]


def transform(df: DataFrame, mesh: Mesh, pairs: Pairs = (("re", "im"),), inverse: bool = False, method: str = "auto") -> DataFrame:
    """From index columns i* to j* (or back if inverse) of the complex fields whose parts the pairs name."""
    if method == "auto":
        method = "sql" if mesh.size <= SQL_CELLS and len(pairs) == 1 else "slab"
    source, target = (mesh.modes, mesh.cells) if inverse else (mesh.cells, mesh.modes)
    df = df.select(*source, *[c for p in pairs for c in p])
    if method == "sql":
        for s, t in zip(source, target):
            df = _axis_sql(df, mesh, s, t, pairs, inverse)
        return df
    if method == "slab":
        return _slabs(df, mesh, pairs, inverse, False)
    if method != "pencil":
        raise ValueError("auto, sql, slab or pencil")
    names = list(source)
    for n, (s, t) in enumerate(zip(source, target)):
        after = [*target[: n + 1], *source[n + 1 :]]
        df = _grouped(df, mesh, names, after, [s], pairs, inverse, max(1, mesh.size // mesh.n * mesh.n // (1 << 17)))
        names = after
    return df


def _axis_sql(df: DataFrame, mesh: Mesh, source: str, target: str, pairs: Pairs, inverse: bool) -> DataFrame:
    n, others = mesh.n, [c for c in df.columns if c != source and not any(c in p for p in pairs)]
    each = df.withColumn(target, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    angle = (1 if inverse else -1) * 2 * math.pi / n * F.pmod(F.col(source) * F.col(target), F.lit(n))
    each = each.withColumn("__c", F.cos(angle)).withColumn("__s", F.sin(angle))
    scale, sums = (1 / n if inverse else 1.0), []
    for re, im in pairs:
        sums += [(F.sum(F.col(re) * F.col("__c") - F.col(im) * F.col("__s")) * scale).alias(re), (F.sum(F.col(re) * F.col("__s") + F.col(im) * F.col("__c")) * scale).alias(im)]
    return each.groupBy(*others, target).agg(*sums)


def _grouped(df: DataFrame, mesh: Mesh, before: list[str], after: list[str], axes: list[str], pairs: Pairs, inverse: bool, groups: int | None) -> DataFrame:
    n, count = mesh.n, len(pairs)
    others = [c for c in before if c not in axes]
    values = [c for p in pairs for c in p]
    key = F.lit(0) if groups is None or not others else F.pmod(F.xxhash64(*others), F.lit(groups)).cast("int")
    schema = ", ".join([*[f"{c} int" for c in after], *[f"{v} double" for v in values]])
    function = np.fft.ifftn if inverse else np.fft.fftn

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shape = [n] * len(axes)
        if others:
            keys, row = np.unique(pdf[others].to_numpy(), axis=0, return_inverse=True)
        else:
            keys, row = np.zeros((1, 0), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
        at = (row.ravel(), *[pdf[a].to_numpy() for a in axes])
        out: dict[str, np.ndarray] = {}
        flat = np.indices((len(keys), *shape)).reshape(1 + len(axes), -1)
        for k, c in enumerate(before):
            out[after[k]] = keys[flat[0], others.index(c)] if c in others else flat[1 + axes.index(c)]
        for k in range(count):
            field = np.zeros((len(keys), *shape), dtype=complex)
            np.add.at(field, at, pdf[values[2 * k]].to_numpy() + 1j * pdf[values[2 * k + 1]].to_numpy())
            field = function(field, axes=tuple(range(1, 1 + len(axes)))).ravel()
            out[values[2 * k]], out[values[2 * k + 1]] = field.real, field.imag
        return pd.DataFrame(out)[[*after, *values]]

    return df.withColumn("__g", key).groupBy("__g").applyInPandas(lambda pdf: run(pdf), schema)


def _slabs(df: DataFrame, mesh: Mesh, pairs: Pairs, inverse: bool, real: bool) -> DataFrame:
    """Planes and columns. Of a real field the pairs' second columns are absent on its side, and the last index of a mode goes to n/2."""
    n, d, count = mesh.n, mesh.dim, len(pairs)
    last = n // 2 + 1 if real else n
    shape = (*[n] * (d - 2), last) if d > 1 else ()  # of the modes of a plane
    columns = math.prod(shape)
    one = mesh.size <= BLOCK_CELLS or d == 1
    planes = n if one else max(1, min(n // 8, GROUP_CELLS // n ** (d - 1)))
    width = columns if one else max(1, min(math.ceil(columns / 8), GROUP_CELLS // n))
    cells, modes = list(mesh.cells), list(mesh.modes)
    first = cells[0] if not inverse else None
    re_names, both = [p[0] for p in pairs], [c for p in pairs for c in p]
    axes = tuple(range(1, d))

    def filled(pdf: pd.DataFrame, at: tuple[np.ndarray, ...], size: tuple[int, ...], k: int, complex_in: bool) -> np.ndarray:
        out = np.zeros(size, dtype=complex if complex_in else float)
        value = pdf[pairs[k][0]].to_numpy(float)
        np.add.at(out, at, value + 1j * pdf[pairs[k][1]].to_numpy(float) if complex_in else value)
        return out

    def rows_of(index: tuple[np.ndarray, ...], names: list[str], fields: list[np.ndarray], complex_out: bool) -> pd.DataFrame:
        out: dict[str, np.ndarray] = dict(zip(names, index, strict=True))
        for k, f in enumerate(fields):
            if complex_out:
                out[pairs[k][0]], out[pairs[k][1]] = f.real.ravel(), f.imag.ravel()
            else:
                out[pairs[k][0]] = f.real.ravel()
        return pd.DataFrame(out)

    def to_modes(fields: np.ndarray) -> np.ndarray:
        """Along all axes but the first (and in one dimension along it)."""
        if d == 1:
            return np.fft.rfft(fields, axis=1) if real else np.fft.fft(fields, axis=1)
        over = tuple(a + 1 for a in axes)
        return np.fft.rfftn(fields, axes=over) if real else np.fft.fftn(fields, axes=over)

    def to_cells(fields: np.ndarray) -> np.ndarray:
        if d == 1:
            return np.fft.irfft(fields, n, axis=1) if real else np.fft.ifft(fields, axis=1)
        over = tuple(a + 1 for a in axes)
        return np.fft.irfftn(fields, (n,) * (d - 1), axes=over) if real else np.fft.ifftn(fields, axes=over)

    cell_schema = ", ".join([*[f"{c} int" for c in cells], *[f"{v} double" for v in (re_names if real else both)]])
    mode_schema = ", ".join([*[f"{c} int" for c in modes], *[f"{v} double" for v in both]])
    if one:

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            names = modes if inverse else cells
            size = (n,) * d if not inverse else (*(n,) * (d - 1), last)
            at = tuple(pdf[c].to_numpy() for c in names)
            fields = np.stack([filled(pdf, at, size, k, inverse or not real) for k in range(count)])
            if inverse:
                out = to_cells(np.fft.ifft(fields, axis=1) if d > 1 else fields)
            else:
                out = to_modes(fields)
                out = np.fft.fft(out, axis=1) if d > 1 else out
            index = tuple(i.ravel().astype(np.int32) for i in np.indices(out.shape[1:]))
            return rows_of(index, cells if inverse else modes, list(out), not (inverse and real))

        return df.groupBy(F.lit(0).alias("__g")).applyInPandas(lambda pdf: whole(pdf), cell_schema if inverse else mode_schema)

    block_schema = "__a int, __b int, __v array<double>"

    def blocks(fields: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(fields).view(float).ravel()

    if not inverse:

        def planes_to_columns(key, pdf: pd.DataFrame) -> pd.DataFrame:
            low = int(key[0]) * planes
            here = min(planes, n - low)
            at = (pdf[first].to_numpy() - low, *(pdf[c].to_numpy() for c in cells[1:]))
            fields = np.stack([filled(pdf, at, (here, *(n,) * (d - 1)), k, not real) for k in range(count)])
            flat = to_modes(fields).reshape(count, here, columns)
            parts = range(math.ceil(columns / width))
            return pd.DataFrame({"__a": np.full(len(parts), key[0], np.int32), "__b": np.array(parts, np.int32), "__v": [blocks(flat[:, :, b * width : (b + 1) * width]) for b in parts]})

        def along_first(key, pdf: pd.DataFrame) -> pd.DataFrame:
            low = int(key[0]) * width
            here = min(width, columns - low)
            fields = np.zeros((count, n, here), dtype=complex)
            for a, v in zip(pdf["__a"], pdf["__v"], strict=True):
                got = np.asarray(v).view(complex).reshape(count, -1, here)
                fields[:, a * planes : a * planes + got.shape[1]] = got
            fields = np.fft.fft(fields, axis=1)
            jx, column = (i.ravel() for i in np.indices((n, here)))
            index = (jx, *np.unravel_index(column + low, shape))
            return rows_of(tuple(i.astype(np.int32) for i in index), modes, list(fields), True)

        dealt = df.withColumn("__a", F.floor(F.col(first) / planes).cast("int")).groupBy("__a").applyInPandas(lambda key, pdf: planes_to_columns(key, pdf), block_schema)
        return dealt.groupBy("__b").applyInPandas(lambda key, pdf: along_first(key, pdf), mode_schema)

    def along_first_back(key, pdf: pd.DataFrame) -> pd.DataFrame:
        low = int(key[0]) * width
        here = min(width, columns - low)
        column = np.ravel_multi_index(tuple(pdf[c].to_numpy() for c in modes[1:]), shape) - low
        fields = np.stack([filled(pdf, (pdf[modes[0]].to_numpy(), column), (n, here), k, True) for k in range(count)])
        fields = np.fft.ifft(fields, axis=1)
        parts = range(math.ceil(n / planes))
        return pd.DataFrame({"__a": np.array(parts, np.int32), "__b": np.full(len(parts), key[0], np.int32), "__v": [blocks(fields[:, a * planes : (a + 1) * planes]) for a in parts]})

    def columns_to_planes(key, pdf: pd.DataFrame) -> pd.DataFrame:
        low = int(key[0]) * planes
        here = min(planes, n - low)
        flat = np.zeros((count, here, columns), dtype=complex)
        for b, v in zip(pdf["__b"], pdf["__v"], strict=True):
            got = np.asarray(v).view(complex).reshape(count, here, -1)
            flat[:, :, b * width : b * width + got.shape[2]] = got
        out = to_cells(flat.reshape(count, here, *shape))
        index = [i.ravel() for i in np.indices(out.shape[1:])]
        index[0] = index[0] + low
        return rows_of(tuple(i.astype(np.int32) for i in index), cells, list(out), not real)

    number = F.lit(0).cast("long")
    for c, size in zip(modes[1:], shape, strict=True):
        number = number * size + F.col(c)
    dealt = df.withColumn("__b", F.floor(number / width).cast("int")).groupBy("__b").applyInPandas(lambda key, pdf: along_first_back(key, pdf), block_schema)
    return dealt.groupBy("__a").applyInPandas(lambda key, pdf: columns_to_planes(key, pdf), cell_schema)


def real_forward(fields: DataFrame, mesh: Mesh, pairs: Pairs | None = None, value: str = "v", method: str = "auto") -> DataFrame:
    """Half spectra of real fields: of a column value as re and im, or of the pairs' first columns under the pairs' names. The last index goes from 0 to n/2."""
    if pairs is None:
        fields, pairs = fields.select(*mesh.cells, F.col(value).alias("re")), (("re", "im"),)
    if method == "sql" or (method == "auto" and mesh.size <= SQL_CELLS and len(pairs) == 1):
        whole = transform(fields.select(*mesh.cells, *[x for a, b in pairs for x in (F.col(a), F.lit(0.0).alias(b))]), mesh, pairs, method="sql")
        return whole.where(F.col(mesh.modes[-1]) <= mesh.n // 2)
    return _slabs(fields.select(*mesh.cells, *[p[0] for p in pairs]), mesh, pairs, False, True)


def real_backward(spectra: DataFrame, mesh: Mesh, pairs: Pairs = (("re", "im"),), value: str | None = "v", method: str = "auto") -> DataFrame:
    """Real fields of half spectra: the pairs' first names, a single one as value. Absent modes are zero; in the planes 0 and n/2 of the last index, modes and their mirrored conjugates have to be both there."""
    if method == "sql" or (method == "auto" and mesh.size <= SQL_CELLS and len(pairs) == 1):
        whole = spectra.select(*mesh.modes, *[c for p in pairs for c in p])
        for k, p in enumerate(pairs):
            one = transform(full_from_half(whole.select(*mesh.modes, F.col(p[0]).alias("re"), F.col(p[1]).alias("im")), mesh), mesh, inverse=True, method="sql").select(*mesh.cells, F.col("re").alias(p[0]))
            out = one if k == 0 else out.join(one, mesh.cells)
    else:
        out = _slabs(spectra.select(*mesh.modes, *[c for p in pairs for c in p]), mesh, pairs, True, True)
    return out.withColumnRenamed(pairs[0][0], value) if value and len(pairs) == 1 else out


def forward(field: DataFrame, mesh: Mesh, value: str = "v", method: str = "auto") -> DataFrame:
    """Spectrum re, im of a real field."""
    return transform(field.select(*mesh.cells, F.col(value).alias("re"), F.lit(0.0).alias("im")), mesh, method=method)


def backward(spectrum: DataFrame, mesh: Mesh, value: str = "v", method: str = "auto") -> DataFrame:
    """Real field of a spectrum."""
    return transform(spectrum, mesh, inverse=True, method=method).select(*mesh.cells, F.col("re").alias(value))


# --- kernels: Columns over the mode indices ---------------------------------------------------------------------------


def gradient_kernel(mesh: Mesh, axis: int, order: int = 0) -> Column:
    """Imaginary part of the derivative's kernel: k with the Nyquist mode zero, or central differences of order 2, 4 or 6."""
    j, h = F.col(mesh.modes[axis]), mesh.box / mesh.n
    k = signed(j, mesh.n) * F.lit(mesh.fundamental)
    if order == 0:
        return F.when(j == mesh.n // 2, 0.0).otherwise(k)
    terms = {2: ((1, 1.0),), 4: ((1, 4 / 3), (2, -1 / 6)), 6: ((1, 1.5), (2, -0.3), (3, 1 / 30))}[order]
    parts = [F.sin(k * (m * h)) * (c / h) for m, c in terms]
    return sum(parts[1:], parts[0])


def inverse_laplacian_kernel(mesh: Mesh, order: int = 0) -> Column:
    """Of the inverse Laplacian: -1 / k^2, or that of central differences; -1 for the mean, which callers set to zero."""
    h = mesh.box / mesh.n
    if order == 0:
        square = -wave_square(mesh)
    else:
        terms = {2: ((0, -2.0), (1, 2.0)), 4: ((0, -2.5), (1, 8 / 3), (2, -1 / 6)), 6: ((0, -49 / 18), (1, 3.0), (2, -0.3), (3, 1 / 45))}[order]
        parts = [F.cos(k * (m * h)) * (c / h**2) for k in wave_numbers(mesh) for m, c in terms]
        square = sum(parts[1:], parts[0])
    mean = sum((F.col(j) for j in mesh.modes[1:]), F.col(mesh.modes[0])) == 0
    return F.when(mean, -1.0).otherwise(F.try_divide(F.lit(1.0), square))


def assignment_kernel(mesh: Mesh, order: int = 2, twice: bool = False, shot_noise: bool = False) -> Column:
    """Inverse of the mass assignment's window (Jing 2005): sinc^-order an axis, or the aliased sum's form; squared if twice."""
    parts = []
    for j in mesh.modes:
        x = F.abs(signed(F.col(j), mesh.n)) * (math.pi / mesh.n)
        if shot_noise:
            s = F.pow(F.sin(x), 2)
            form = {2: 1 - s * (2 / 3), 3: 1 - s + s * s * (2 / 15), 4: 1 - s * (4 / 3) + s * s * 0.4 - s * s * s * (4 / 315)}[order]
            parts.append(F.pow(form, -0.5 * (2 if twice else 1)))
        else:
            sinc = F.when(x == 0, 1.0).otherwise(F.sin(x) / F.when(x == 0, 1.0).otherwise(x))
            parts.append(F.pow(sinc, -float(order * (2 if twice else 1))))
    out = parts[0]
    for p in parts[1:]:
        out = out * p
    return out


def scaled(spectrum: DataFrame, factor: Column) -> DataFrame:
    return spectrum.withColumn("__f", factor).withColumn("re", F.col("re") * F.col("__f")).withColumn("im", F.col("im") * F.col("__f")).drop("__f")


def without_mean(spectrum: DataFrame, mesh: Mesh) -> DataFrame:
    mean = sum((F.col(j) for j in mesh.modes[1:]), F.col(mesh.modes[0])) == 0
    return spectrum.withColumn("re", F.when(mean, 0.0).otherwise(F.col("re"))).withColumn("im", F.when(mean, 0.0).otherwise(F.col("im")))


def deconvolved(field: DataFrame, mesh: Mesh, order: int = 2, twice: bool = False) -> DataFrame:
    """A field divided by its assignment window."""
    return real_backward(scaled(real_forward(field, mesh), assignment_kernel(mesh, order, twice)), mesh)


def potential(delta: DataFrame, mesh: Mesh, order: int = 0) -> DataFrame:
    """phi with Laplacian delta and no mean."""
    return real_backward(scaled(without_mean(real_forward(delta, mesh), mesh), inverse_laplacian_kernel(mesh, order)), mesh)


def density(phi: DataFrame, mesh: Mesh) -> DataFrame:
    """delta = Laplacian of phi."""
    return real_backward(scaled(real_forward(phi, mesh), -wave_square(mesh)), mesh)


def derivative(field: DataFrame, mesh: Mesh, axis: int, order: int = 0) -> DataFrame:
    f = real_forward(field, mesh).withColumn("__k", gradient_kernel(mesh, axis, order))
    return real_backward(f.select(*mesh.modes, (-F.col("im") * F.col("__k")).alias("re"), (F.col("re") * F.col("__k")).alias("im")), mesh)


def dealiased_product(a: DataFrame, b: DataFrame, mesh: Mesh) -> DataFrame:
    """Spectrum of the product of two fields given by spectra, free of aliasing by the 3/2 rule."""
    large = mesh.at(3 * mesh.n // 2)
    x, y = (transform(pad(f, mesh, large, keep_mean=True), large, inverse=True).select(*mesh.cells, F.col("re").alias(n)) for f, n in ((a, "__a"), (b, "__b")))
    product = x.join(y, mesh.cells).select(*mesh.cells, (F.col("__a") * F.col("__b")).alias("v"))
    return crop(forward(product, large), mesh, large)


def hermitian(spectrum: DataFrame, mesh: Mesh) -> DataFrame:
    """A half spectrum whose planes 0 and n/2 of the last axis are made the spectrum of a real field: of two mirrored modes the lower index stays, self-mirrored modes lose their imaginary part."""
    n, last = mesh.n, mesh.modes[-1]
    others = mesh.modes[:-1]
    plane = (F.col(last) == 0) | (F.col(last) == n // 2)
    number = lambda cs: sum((c * n ** (len(cs) - 1 - k) for k, c in enumerate(cs)), F.lit(0))
    own = number([F.col(j) for j in others])
    mirrored = number([F.pmod(-F.col(j), F.lit(n)) for j in others])
    kept = spectrum.where(~plane | (own <= mirrored)).withColumn("im", F.when(plane & (own == mirrored), 0.0).otherwise(F.col("im")))
    twins = kept.where(plane & (own < mirrored)).select(*[F.pmod(-F.col(j), F.lit(n)).cast("int").alias(j) for j in others], last, "re", (-F.col("im")).alias("im"))
    return kept.select(*mesh.modes, "re", "im").unionByName(twins)


def full_from_half(spectrum: DataFrame, mesh: Mesh) -> DataFrame:
    """All modes from the half spectrum of a real field."""
    last = F.col(mesh.modes[-1])
    twins = spectrum.where((last > 0) & (last < mesh.n // 2)).select(*[F.pmod(-F.col(j), F.lit(mesh.n)).cast("int").alias(j) for j in mesh.modes], "re", (-F.col("im")).alias("im"))
    return spectrum.select(*mesh.modes, "re", "im").unionByName(twins)


def mode_order(modes: DataFrame, mesh: Mesh, kind: str = "stable") -> DataFrame:
    """rank of every mode in its half spectrum: stable under refinement (by the largest index, positive before negative), or natural (axis by axis).

    The rank is counted from the mode's own indices, so it needs no sort and no other rows.
    """
    n = mesh.n
    # along a full axis modes come as 0, 1, -1, 2, -2 ...; along the last as 0, 1, 2 ...
    place = lambda j: F.when(j == 0, 0).when(j < n - j, 2 * j - 1).when(j == n - j, n - 1).otherwise(2 * (n - j))
    places, last = [place(F.col(j).cast("long")) for j in mesh.modes[:-1]], F.col(mesh.modes[-1]).cast("long")
    if kind == "natural":
        rank = F.lit(0).cast("long")
        for p in places:
            rank = rank * n + p
        return modes.withColumn("rank", rank * (n // 2 + 1) + last)
    if kind != "stable":
        raise ValueError("stable or natural")
    names = [f"__{m}" for m in range(len(places) + 2)]
    wide = F.greatest(2 * last - 1, F.lit(0))
    named = modes.withColumns(dict(zip(names, [*places, wide, F.greatest(*places, wide) if places else wide], strict=True)))
    *axes, top = [F.col(m) for m in names]

    def up_to(first: int, most: Column) -> Column:
        """How many choices of the axes from the first on stay within most, -1 or more."""
        count = F.lit(1).cast("long")
        for a in range(first, len(axes)):
            count = count * (most + 1 if a < len(axes) - 1 else F.when(most < 0, 0).otherwise(1 + F.floor((most + 1) / 2)))
        return count

    rank, seen = up_to(0, top - 1), F.lit(-1).cast("long")
    for a, value in enumerate(axes):  # modes of the same largest index that are equal before this axis and smaller at it
        smaller = value if a < len(axes) - 1 else last
        rank = rank + smaller * F.when(seen == top, up_to(a + 1, top)).otherwise(up_to(a + 1, top) - up_to(a + 1, top - 1))
        seen = F.greatest(seen, value)
    return named.withColumn("rank", rank.cast("long")).drop(*names)


def shifted(field: DataFrame, mesh: Mesh, shift: tuple[float, ...], how: str = "fourier") -> DataFrame:
    """The field's values at every cell's position plus a shift in box units, by phases or by linear interpolation."""
    if how == "linear":
        out = None
        from itertools import product

        cells = [s * mesh.n / mesh.box for s in shift]
        for corner in product((0, 1), repeat=mesh.dim):
            w = math.prod((c - math.floor(c)) if b else 1 - (c - math.floor(c)) for c, b in zip(cells, corner))
            part = field.select(*[F.pmod(F.col(i) - math.floor(c) - b, F.lit(mesh.n)).cast("int").alias(i) for i, c, b in zip(mesh.cells, cells, corner)], (F.col("v") * w).alias("v"))
            out = part if out is None else out.unionByName(part)
        return out.groupBy(*mesh.cells).agg(F.sum("v").alias("v"))
    angle = sum((k * s for k, s in zip(wave_numbers(mesh), shift)), F.lit(0.0))
    f = forward(field, mesh).withColumn("__c", F.cos(angle)).withColumn("__s", F.sin(angle))
    return backward(f.select(*mesh.modes, (F.col("re") * F.col("__c") - F.col("im") * F.col("__s")).alias("re"), (F.col("re") * F.col("__s") + F.col("im") * F.col("__c")).alias("im")), mesh)


def long_range(spectrum: DataFrame, mesh: Mesh, alpha: float) -> DataFrame:
    """Gaussian split of a force: the long-range part."""
    return scaled(spectrum, F.exp(wave_square(mesh) * (-0.5 * alpha**2)))


def interlaced(particles: DataFrame, mesh: Mesh, order: int = 2, count: int | None = None) -> DataFrame:
    """Overdensity averaged with that of a grid moved by half a cell, moved back by phases: odd aliases cancel."""
    from .particles import overdensity

    step = mesh.box / mesh.n / 2
    moved = particles.select("*").withColumns({x: F.col(x) + step for x in mesh.places})
    back = shifted(overdensity(moved, mesh, order, count), mesh, (step,) * mesh.dim).select(*mesh.cells, F.col("v").alias("__b"))
    return overdensity(particles, mesh, order, count).join(back, mesh.cells).select(*mesh.cells, ((F.col("v") + F.col("__b")) / 2).alias("v"))


