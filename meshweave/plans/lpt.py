"""Lagrangian perturbation theory on wide rows.

All gradients of the displacement orders live as columns of one padded mesh, so a recursion step is column algebra
in real space between one inverse pass (the newest order's gradients) and one forward pass (its sources). Recursion:
psi_n = inverse Laplacian of (grad L - curl T), with the sums of arXiv:2010.12584 and arXiv:1811.05634.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cosmology import Times, expansion
from ..operators.fourier import gradient_kernel, transform, without_mean
from ..operators.mesh import AXES, Mesh, cell_id, crop, pad, signed, wave_square


def _method(mesh: Mesh) -> str:
    return "slab"


def _gradients(psi: DataFrame, mesh: Mesh, large: Mesh, n: int) -> DataFrame:
    """Columns g{n}_{a}{b} = d psi_a / d q_b of one order on the padded mesh, from spectrum columns r{a}, i{a}."""
    d, cols, pairs = mesh.dim, [], []
    for a in range(d):
        for b in range(d):
            k = gradient_kernel(mesh, b)
            cols += [(-F.col(f"i{a}") * k).alias(f"g{n}_{a}{b}"), (F.col(f"r{a}") * k).alias(f"__{a}{b}")]
            pairs.append((f"g{n}_{a}{b}", f"__{a}{b}"))
    padded = pad(psi.select(*mesh.modes, *cols), mesh, large, tuple(c for p in pairs for c in p))
    return transform(padded, large, tuple(pairs), inverse=True, method=_method(large)).select(*large.cells, *[p[0] for p in pairs])


def _cofactor(n: int, m: int, i: int, j: int, a: int, b: int) -> Column:
    g = lambda o, x, y: F.col(f"g{o}_{x}{y}")
    return g(n, a, i) * g(m, b, j) - g(n, a, j) * g(m, b, i)


def _second(n: int, m: int, d: int) -> Column:
    """Half the sum over a != b of g_aa g_bb - g_ab g_ba, with both orders' roles exchanged where they differ."""
    g = lambda o, x, y: F.col(f"g{o}_{x}{y}")
    out = F.lit(0.0)
    for a in range(d):
        for b in range(d):
            if a != b:
                out = out + (g(n, a, a) * g(m, b, b) - g(n, a, b) * g(m, b, a)) * (0.5 if n == m else 1.0)
    return out


def _transverse(n: int, m: int, d: int) -> list[Column]:
    """Components of the sum over l of grad psi^n_l x grad psi^m_l."""
    g = lambda o, x, y: F.col(f"g{o}_{x}{y}")
    axes = [(1, 2), (2, 0), (0, 1)] if d == 3 else [(0, 1)]
    return [sum((g(n, l, i) * g(m, l, j) - g(n, l, j) * g(m, l, i) for l in range(d)), F.lit(0.0)) for i, j in axes]


def _solved(mesh: Mesh, straight: tuple[Column, Column], turn: list[tuple[Column, Column]]) -> list[Column]:
    """r{a}, i{a}: inverse Laplacian of i k L - i (k x T), written for real and imaginary parts."""
    d, over = mesh.dim, F.try_divide(F.lit(-1.0), wave_square(mesh))
    ks, out = [gradient_kernel(mesh, a) for a in range(d)], []
    for a in range(d):
        if d == 3:
            b, c = (a + 1) % 3, (a + 2) % 3
            im, re = (ks[a] * straight[p] - (ks[b] * turn[c][p] - ks[c] * turn[b][p]) for p in (0, 1))
        else:
            other, sign = (ks[1], 1.0) if a == 0 else (ks[0], -1.0)
            im, re = (ks[a] * straight[p] - other * turn[0][p] * sign for p in (0, 1))
        out += [F.coalesce(-re * over, F.lit(0.0)).alias(f"r{a}"), F.coalesce(im * over, F.lit(0.0)).alias(f"i{a}")]
    return out


def displacements(potential: DataFrame, mesh: Mesh, order: int = 1, transverse: bool = True, factors: bool = True, split: bool = False) -> DataFrame:
    """id and s{n}x, s{n}y, s{n}z of the orders 1 to order, from the potential's full spectrum re, im.

    split also gives the third order's parts, whose growth differs beyond an Einstein-de Sitter background: s3a (of three
    first orders), s3b (of the first and the second) and s3c (transverse), which add up to s3.
    """
    d, large = mesh.dim, mesh.at(3 * mesh.n // 2 + (3 * mesh.n // 2) % 2)
    phi = without_mean(potential, mesh)
    first = phi.select(*mesh.modes, *[c for a in range(d) for k in (gradient_kernel(mesh, a),) for c in ((F.col("im") * k).alias(f"r{a}"), (-F.col("re") * k).alias(f"i{a}"))])
    spectra, real = {1: first.checkpoint()}, None
    if d == 1 and order > 1:
        raise ValueError("in one dimension the first order is exact")
    for n in range(2, order + 1):
        newest = _gradients(spectra[n - 1], mesh, large, n - 1)
        real = newest if real is None else real.join(newest, large.cells)
        real = real.checkpoint()
        scale = lambda *parts: ((3 - n) / 2 - sum(p * p for p in parts)) / ((n + 1.5) * (n - 1)) if factors else 1.0  # noqa: E731, B023
        longitudinal, turning = F.lit(0.0), [F.lit(0.0)] * (3 if d == 3 else 1)
        for j in range(1, n // 2 + 1):
            longitudinal = longitudinal + _second(j, n - j, d) * scale(j, n - j)
            if j != n - j and transverse:
                turning = [t + c * ((1 - 2 * j / n) if factors else 1.0) for t, c in zip(turning, _transverse(j, n - j, d))]
        columns = {"L": longitudinal, **{f"T{k}": t for k, t in enumerate(turning)}}
        triples = [(k, l, n - k - l) for k in range(1, n - 1) for l in range(1, n - k)] if d == 3 else []
        if triples:
            # cofactors are products of two; made free of aliases before the third factor comes in
            pairs_needed = sorted({(l, m) for _, l, m in triples})
            cof = {f"C{l}_{m}_{c}": _cofactor(l, m, *[(1, 2), (2, 0), (0, 1)][c], 1, 2) for l, m in pairs_needed for c in range(3)}
            names = list(cof)
            spectrum = transform(real.select(*large.cells, *[x for c in names for x in (cof[c].alias(c), F.lit(0.0).alias(f"_{c}"))]), large, tuple((c, f"_{c}") for c in names), method=_method(large))
            low = spectrum
            for j in mesh.modes:
                low = low.where(F.abs(signed(F.col(j), large.n)) < mesh.n // 2)
            clean = transform(low, large, tuple((c, f"_{c}") for c in names), inverse=True, method=_method(large)).select(*large.cells, *names)
            real3 = real.join(clean, large.cells)
            columns["A"] = F.lit(0.0)
            for k, l, m in triples:
                columns["A"] = columns["A"] + sum((F.col(f"g{k}_0{c}") * F.col(f"C{l}_{m}_{c}") for c in range(3)), F.lit(0.0)) * scale(k, l, m)
        else:
            real3 = real
        names = list(columns)
        sources = transform(real3.select(*large.cells, *[x for c in names for x in (columns[c].alias(c), F.lit(0.0).alias(f"_{c}"))]), large, tuple((c, f"_{c}") for c in names), method=_method(large))
        s = crop(sources, mesh, large, tuple(x for c in names for x in (c, f"_{c}")))
        if split and n == 3:
            s = s.checkpoint()
        zero, straight = F.lit(0.0), [c for c in ("L", "A") if c in columns]
        turn = [(F.col(f"T{k}"), F.col(f"_T{k}")) for k in range(len(turning))]
        still = [(zero, zero)] * len(turning)
        whole = tuple(sum((F.col(p + c) for c in straight), zero) for p in ("", "_"))
        spectra[n] = s.select(*mesh.modes, *_solved(mesh, whole, turn)).checkpoint()
        if split and n == 3:
            parts = {"3a": ((F.col("A"), F.col("_A")) if "A" in columns else (zero, zero), still), "3b": ((F.col("L"), F.col("_L")), still), "3c": ((zero, zero), turn)}
            spectra |= {k: s.select(*mesh.modes, *_solved(mesh, *v)) for k, v in parts.items()}
    wide = None
    for n, s in spectra.items():
        part = s.select(*mesh.modes, *[F.col(f"{p}{a}").alias(f"{p}{n}_{a}") for a in range(d) for p in "ri"])
        wide = part if wide is None else wide.join(part, mesh.modes, "left")
    names = [(n, a) for n in spectra for a in range(d)]
    filled = wide.fillna(0.0)
    cells = transform(filled, mesh, tuple((f"r{n}_{a}", f"i{n}_{a}") for n, a in names), inverse=True, method=_method(mesh))
    return cells.select(cell_id(mesh).alias("id"), *[F.col(f"r{n}_{a}").alias(f"s{n}{AXES[a]}") for n, a in names])


#: The Einstein-de Sitter factors that the displacement columns hold, by growth column.
EDS_FACTORS = {"1": ("Dplus", 1.0), "2": ("D2plus", -3 / 7), "3a": ("D3plusa", 1 / 3), "3b": ("D3plusb", -10 / 21), "3c": ("D3plusc", 1 / 7)}


def exact_factors(times: Times, a: float, order: int, what: str) -> dict[str, float]:
    """A factor for each part s1, s2, s3a, s3b, s3c from the growth table instead of powers of D."""
    if order > 3:
        raise ValueError("exact growth goes to third order")
    parts = ["1", "2", "3a", "3b", "3c"][: {1: 1, 2: 2, 3: 5}[order]]
    d = {p: float(times.get(EDS_FACTORS[p][0], a)) for p in parts}
    slope = {p: float(times.get(EDS_FACTORS[p][0] + "da", a)) for p in parts}
    e = float(expansion(times.cosmology, np.float64(a), np))
    if what == "acceleration":  # each growth equation's right side over 1.5 Omega_m(a)
        one = d["1"]
        more = {"1": lambda: one, "2": lambda: d["2"] - one**2, "3a": lambda: d["3a"] + 2 * one**3, "3b": lambda: d["3b"] + 2 * one * d["2"] - 2 * one**3, "3c": lambda: one**3}
        out = {p: more[p]() for p in parts}
    else:
        out = {"psi": d, "velocity": {p: slope[p] * a**3 * e for p in parts}, "D": {p: slope[p] / slope["1"] for p in parts}}[what]
    return {p: out[p] / EDS_FACTORS[p][1] for p in parts}


def evaluated(orders: DataFrame, mesh: Mesh, times: Times, a: float, order: int, what: str = "psi", exact: bool = False) -> DataFrame:
    """id and sx, sy, sz at scale factor a: displacement (psi), momentum a^2 dx/dt (velocity), derivative by D, or Eulerian acceleration.

    exact: each part grows by the cosmology's own growth functions; the third order needs displacements with split. At a = 0 psi is zero.
    """
    if exact and a > 0:
        factors = exact_factors(times, a, order, what)
    else:
        grow, rate = (float(times.get("Dplus", a)), float(times.growth_rate(a))) if a > 0 else (0.0, 1.0)
        e = float(expansion(times.cosmology, np.float64(a), np)) if a > 0 else 0.0
        factor = {
            "psi": lambda n: grow**n,
            "velocity": lambda n: n * grow**n * rate * e * a**2,
            "D": lambda n: n * grow ** (n - 1),
            "acceleration": lambda n: n / 3 * (1 + 2 * n) * grow**n,
        }[what]
        factors = {str(n): factor(n) for n in range(1, order + 1)}
    first, *rest = factors
    return orders.select("id", *[sum((F.col(f"s{n}{x}") * factors[n] for n in rest), F.col(f"s{first}{x}") * factors[first]).alias(f"s{x}") for x in AXES[: mesh.dim]])
