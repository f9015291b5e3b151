"""DuckDB SQL that states the registered queries again, independently of the operators."""

from __future__ import annotations

import math

from ..functions.cosmology import PLANCK15, Cosmology

L, N = 100.0, 8
TAU = repr(2 * math.pi)


def pmod(a: str, b) -> str:
    return f"(CASE WHEN ({a}) % {b} < 0 THEN (({a}) % {b} + {b}) % {b} ELSE ({a}) % {b} END)"


def q(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


PART = f"""part AS (SELECT event_id AS id, CAST((event_id * 7919 + user_id * 104729) % 100003 AS DOUBLE) / 100003 * {L} AS x,
    {pmod('value * 37', L)} AS y, CAST(epoch_us(ts) % 86400000000 AS DOUBLE) / 86400000000 * {L} AS z, value AS v FROM events)"""
MOVING = PART + ", moving AS (SELECT id, x, y, z, v / 100 AS px, v / 200 - 0.1 AS py, v / 50 - 0.5 AS pz FROM part)"
LINE = f"line AS (SELECT o_orderkey AS id, {pmod('o_totalprice', L)} AS x, o_totalprice / 500000 AS p FROM orders)"


def cells(n: int = N, name: str = "cells", to: tuple[str, ...] = ("ix", "iy", "iz")) -> str:
    return f"{name} AS (SELECT CAST(i // {n * n} AS INTEGER) AS {to[0]}, CAST(i // {n} % {n} AS INTEGER) AS {to[1]}, CAST(i % {n} AS INTEGER) AS {to[2]}, i AS id FROM range({n**3}) t(i))"


KTABLE = "ktable AS (SELECT event_id AS id, 0.001 + value / 100 AS k FROM events)"
SPECTRUM = "pk AS (SELECT i, k, k / pow(1 + pow(k / 0.02, 2), 2) AS pk FROM (SELECT i, pow(CAST(i + 1 AS DOUBLE), 1.5) * 1e-3 AS k FROM (SELECT DISTINCT CAST(floor(value) AS INTEGER) AS i FROM events)))"
FACTORS = "factors AS (SELECT event_id AS id, 0.05 + value / 100 AS a FROM events)"
TIMES = "factors AS (SELECT i, CAST(i + 1 AS DOUBLE) / (max(i) OVER () + 1) AS a FROM (SELECT DISTINCT CAST(floor(value) AS INTEGER) AS i FROM events))"
AXES = (("ix", "jx"), ("iy", "jy"), ("iz", "jz"))


def dft(source: str, out: str, n: int = N, inverse: bool = False, axes=AXES) -> str:
    """CTEs of a transform axis by axis: source has re, im."""
    names = [a[1] if inverse else a[0] for a in axes]
    ctes, current = [], source
    for k, a in enumerate(axes):
        s, t = (a[1], a[0]) if inverse else a
        others = [x for x in names if x != s]
        angle = f"({'' if inverse else '-'}{TAU} / {n} * (({s} * j) % {n}))"
        scale = f" / {n}" if inverse else ""
        name = out if k == len(axes) - 1 else f"{out}_{k}"
        ctes.append(f"{name} AS (SELECT {', '.join([*others, f'CAST(j AS INTEGER) AS {t}'])}, sum(re * cos{angle} - im * sin{angle}){scale} AS re, sum(re * sin{angle} + im * cos{angle}){scale} AS im FROM {current}, range({n}) r(j) GROUP BY {', '.join([*others, 'j'])})")
        names = [t if x == s else x for x in names]
        current = name
    return ", ".join(ctes)


def sg(j: str, n: int = N) -> str:
    return f"(CASE WHEN {j} < {n // 2} THEN {j} ELSE {j} - {n} END)"


def kk(j: str, n: int = N, box: float = L) -> str:
    return f"({sg(j, n)} * {TAU} / {box})"


K2 = f"({kk('jx')} * {kk('jx')} + {kk('jy')} * {kk('jy')} + {kk('jz')} * {kk('jz')})"
MODES = cells(N, "modes", ("jx", "jy", "jz"))


def share(d: str, order: int) -> str:
    return {
        1: "1.0",
        2: f"greatest(0.0, 1 - {d})",
        3: f"CASE WHEN {d} <= 0.5 THEN 0.75 - {d} * {d} WHEN {d} <= 1.5 THEN (1.5 - {d}) * (1.5 - {d}) / 2 ELSE 0 END",
        4: f"CASE WHEN {d} <= 1 THEN (4 - 6 * {d} * {d} + 3 * {d} * {d} * {d}) / 6 WHEN {d} <= 2 THEN pow(2 - {d}, 3) / 6 ELSE 0 END",
    }[order]


def stencil(source: str, order: int, n: int = N, axes: tuple[str, ...] = ("x", "y", "z"), out: str = "sten") -> str:
    """CTE of a particle's cells and shares."""
    offsets = {1: [0], 2: [0, 1], 3: [-1, 0, 1], 4: [-1, 0, 1, 2]}[order]
    values = ", ".join(f"({o})" for o in offsets)
    base = (lambda x: f"floor(g{x})") if order % 2 == 0 else (lambda x: f"round_even(g{x}, 0)")
    g = ", ".join(f"{pmod(x, L)} / {L} * {n} AS g{x}" for x in axes)
    pick = ", ".join(f"CAST({pmod(f'CAST({base(x)} AS BIGINT) + o{x}.o', n)} AS INTEGER) AS i{x}" for x in axes)
    w = " * ".join(f"({share(f'abs(g{x} - {base(x)} - o{x}.o)', order)})" for x in axes)
    froms = ", ".join(f"(VALUES {values}) o{x}(o)" for x in axes)
    return f"{out} AS (SELECT s.*, {pick}, {w} AS w FROM (SELECT *, {g} FROM {source}) s, {froms})"


def deposited(order: int) -> str:
    return f"WITH {PART}, {stencil('part', order)}, {cells()}, d AS (SELECT ix, iy, iz, sum(w) AS v FROM sten GROUP BY ix, iy, iz) SELECT c.ix, c.iy, c.iz, {q(f'coalesce(d.v, 0) / ((SELECT count(*) FROM part) / {N**3}.0) - 1')} AS v FROM cells c LEFT JOIN d USING (ix, iy, iz)"


def gathered(order: int) -> str:
    return f"WITH {WAVES}, {stencil('part', order)} SELECT id, {q('sum(w * waves.v)')} AS v FROM sten JOIN waves USING (ix, iy, iz) GROUP BY id"




def spectral(expression_re: str, expression_im: str, digits: int = 6) -> str:
    """Waves to modes, a factor, and back to the mesh."""
    return f"WITH {WAVE_SPECTRUM}, g AS (SELECT jx, jy, jz, {expression_re} AS re, {expression_im} AS im FROM f), {dft('g', 'b', inverse=True)} SELECT ix, iy, iz, {q('re', digits)} AS v FROM b"


def gradient(j: str, order: int, n: int = N, box: float = L) -> str:
    k, h = kk(j, n, box), box / n
    return {
        0: f"CASE WHEN {j} = {n // 2} THEN 0.0 ELSE {k} END",
        2: f"sin({k} * {h}) / {h}",
        4: f"(8 * sin({k} * {h}) - sin(2 * {k} * {h})) / (6 * {h})",
        6: f"(45 * sin({k} * {h}) - 9 * sin(2 * {k} * {h}) + sin(3 * {k} * {h})) / (30 * {h})",
    }[order]


def laplace(order: int) -> str:
    h = L / N
    one = lambda j: {
        0: f"-{kk(j)} * {kk(j)}",
        2: f"-2 * (1 - cos({kk(j)} * {h})) / {h * h}",
        4: f"-(cos(2 * {kk(j)} * {h}) - 16 * cos({kk(j)} * {h}) + 15) / {6 * h * h}",
        6: f"-(-2 * cos(3 * {kk(j)} * {h}) + 27 * cos(2 * {kk(j)} * {h}) - 270 * cos({kk(j)} * {h}) + 245) / {90 * h * h}",
    }[order]
    total = " + ".join(f"({one(j)})" for j in ("jx", "jy", "jz"))
    return f"CASE WHEN jx = 0 AND jy = 0 AND jz = 0 THEN -1.0 ELSE 1.0 / nullif({total}, 0) END"


def sinc(j: str, power: int) -> str:
    x = f"(abs({sg(j)}) * {math.pi!r} / {N})"
    return f"pow(CASE WHEN {x} = 0 THEN 1.0 ELSE sin({x}) / {x} END, {-power})"


LOG_EDGES = [math.exp(math.log(2 * math.pi / L) + (n - 0.5) * (math.log(N / 2) / 5)) for n in range(7)]


def binned(source: str, columns: str) -> str:
    bins = " ".join(f"WHEN k < {e!r} THEN {n - 1}" for n, e in enumerate(LOG_EDGES))
    return f"SELECT bin, {columns} FROM (SELECT *, CASE {bins} ELSE -1 END AS bin FROM (SELECT *, sqrt({K2}) AS k, CASE WHEN jz > 0 AND jz < {N // 2} THEN 2 ELSE 1 END AS m FROM {source} WHERE jz <= {N // 2})) WHERE bin >= 0 GROUP BY bin"


def expansion(c: Cosmology, a: str = "a") -> str:
    return f"sqrt({c.Omega_m!r} * pow({a}, -3) + {c.Omega_k!r} * pow({a}, -2) + {c.Omega_de!r} * pow({a}, {-3 * (1 + c.w0 + c.wa)!r}) * exp(-3 * {c.wa!r} * (1 - {a})))"


def transfer_eh(c: Cosmology, k: str = "k") -> str:
    """The fitting formula with its parameters folded by this function, in its own arrangement."""
    th = 2.72548 / 2.7
    w, wb, f = c.Omega_m * c.h**2, c.Omega_b * c.h**2, c.Omega_b / c.Omega_m
    ze, ke = 25000 * w * th**-4, 0.0746 * w * th**-2
    b1, b2 = 0.313 * w**-0.419 * (1 + 0.607 * w**0.674), 0.238 * w**0.223
    zd = 1291 * w**0.251 / (1 + 0.659 * w**0.828) * (1 + b1 * wb**b2)
    rd, re = 31.5 * wb * th**-4 * 1000 / (1 + zd), 31.5 * wb * th**-4 * 1000 / ze
    s = 2 / 3 / ke * math.sqrt(6 / re) * math.log((math.sqrt(1 + rd) + math.sqrt(rd + re)) / (1 + math.sqrt(re)))
    ks = 1.6 * wb**0.52 * w**0.73 * (1 + (10.4 * w) ** -0.95)
    ac = (46.9 * w) ** (-0.67 * f) * (1 + (32.1 * w) ** -0.532) ** -f * ((12 * w) ** 0.424 * (1 + (45 * w) ** -0.582)) ** -(f**3)
    bc = 1 / (1 + 0.944 / (1 + (458 * w) ** -0.708) * ((1 - f) ** ((0.395 * w) ** -0.0266) - 1))
    y = (1 + ze) / (1 + zd)
    ab = 2.07 * ke * s * (1 + rd) ** -0.75 * y * (-6 * math.sqrt(1 + y) + (2 + 3 * y) * math.log((math.sqrt(1 + y) + 1) / (math.sqrt(1 + y) - 1)))
    bb, bn = 0.5 + f + (3 - 2 * f) * math.sqrt((17.2 * w) ** 2 + 1), 8.41 * w**0.435
    p = f"({k} * {c.h!r})"
    qq = f"({p} / {13.41 * ke!r})"
    t0 = lambda a, b: f"(ln({math.e!r} + {1.8 * b!r} * {qq}) / (ln({math.e!r} + {1.8 * b!r} * {qq}) + ({14.2 / a!r} + 386 / (1 + 69.9 * pow({qq}, 1.08))) * {qq} * {qq}))"
    mix = f"(1 / (1 + pow({p} * {s / 5.4!r}, 4)))"
    cold = f"({mix} * {t0(1.0, bc)} + (1 - {mix}) * {t0(ac, bc)})"
    x = f"({p} * {s!r} / pow(1 + pow({bn / s!r} / {p}, 3), {1 / 3!r}))"
    warm = f"(sin({x}) / {x} * ({t0(1.0, 1.0)} / (1 + pow({p} * {s / 5.2!r}, 2)) + {ab!r} / (1 + pow({bb / s!r} / {p}, 3)) * exp(-pow({p} / {ks!r}, 1.4))))"
    return f"({f!r} * {warm} + {1 - f!r} * {cold})"


def transfer_bbks(c: Cosmology, k: str = "k") -> str:
    x = f"({k} * {math.sqrt((1 + 3.046 * 7 / 8 * (4 / 11) ** (4 / 3)) / 1.68) / (c.Omega_c * c.h**2)!r})"
    return f"(ln(1 + 2.34 * {x}) / (2.34 * {x}) * pow(1 + 3.89 * {x} + pow(16.1 * {x}, 2) + pow(5.46 * {x}, 3) + pow(6.71 * {x}, 4), -0.25))"


def transfer_ga(c: Cosmology, k: str = "k") -> str:
    x = f"({k} / {c.Omega_c * c.h**2!r})"
    return f"pow(1 + 59.0998 * pow({x}, 1.49177) + 4658.01 * pow({x}, 4.02755) + 3170.79 * pow({x}, 6.06) + 150.089 * pow({x}, 7.28478), -0.25)"


def sigma2(source: str) -> str:
    x = "(k * 8)"
    f = f"k * k * k * pk * pow(3 * (sin({x}) - {x} * cos({x})) / pow({x}, 3), 2)"
    return f"(SELECT sum((ln(k2) - ln(k)) * (f + f2) / 2) / {2 * math.pi**2!r} FROM (SELECT k, f, lead(k) OVER (ORDER BY k) AS k2, lead(f) OVER (ORDER BY k) AS f2 FROM (SELECT k, {f} AS f FROM {source})))"


def min_image(a: str) -> str:
    return f"({pmod(f'{a} + {L / 2}', L)} - {L / 2})"


def bits(c: str, shift: int, n: int = 10) -> str:
    return " | ".join(f"((({c} >> {b}) & 1) << {3 * b + shift})" for b in range(n))


PLANCK = PLANCK15
KZ = kk("jz")


def slope(d: str) -> str:
    """Derivative of the triangular cloud's share by a signed distance in cells."""
    return f"(CASE WHEN abs({d}) <= 0.5 THEN -2 * {d} WHEN abs({d}) <= 1.5 THEN sign({d}) * (abs({d}) - 1.5) ELSE 0.0 END)"


def density(source: str, order: int, name: str, n: int = N) -> str:
    """CTEs of a source's overdensity on the mesh, as name with re and im."""
    return f"{stencil(source, order, n, out=f'{name}_s')}, {name}_d AS (SELECT ix, iy, iz, sum(w) AS v FROM {name}_s GROUP BY ALL), {name} AS (SELECT c.ix, c.iy, c.iz, coalesce(d.v, 0) / ((SELECT count(*) FROM {source}) / {n**3}.0) - 1 AS re, 0.0 AS im FROM cells c LEFT JOIN {name}_d d USING (ix, iy, iz))"


FIELD = f"{cells()}, {density('part', 2, 'dens')}, waves AS (SELECT ix, iy, iz, re AS v FROM dens)"
WAVES = f"{PART}, {FIELD}"
WAVE_SPECTRUM = WAVES + ", field AS (SELECT ix, iy, iz, v AS re, 0.0 AS im FROM waves), " + dft("field", "f")


def moves(order: int = 3) -> tuple[list[str], str]:
    """The derivative of a particle's share by x, y and z, and a CTE of its cells, for the triangular cloud."""
    far = {x: f"(g{x} - round_even(g{x}, 0) - o{x})" for x in "xyz"}
    one = {x: share(f"abs({far[x]})", order) for x in "xyz"}
    grads = [" * ".join([f"{slope(far[x])} * {N / L!r}", *[f"({one[y]})" for y in "xyz" if y != x]]) for x in "xyz"]
    froms = ", ".join(f"(VALUES (-1), (0), (1)) t{x}(o{x})" for x in "xyz")
    g = ", ".join(f"{pmod(x, L)} / {L} * {N} AS g{x}" for x in "xyz")
    pick = ", ".join(f"CAST({pmod(f'CAST(round_even(g{x}, 0) AS BIGINT) + o{x}', N)} AS INTEGER) AS i{x}" for x in "xyz")
    return [f"d{x}" for x in "xyz"], f"move AS (SELECT s.*, {pick}, {', '.join(f'{e} AS d{x}' for e, x in zip(grads, 'xyz'))} FROM (SELECT *, {g} FROM moving) s, {froms})"


def time_maps() -> str:
    """Eight knots of a, superconformal time and growth, and linear steps between them."""

    def line(x: str, key: str, to: str) -> str:
        return f"(SELECT coalesce(max(CASE WHEN {x} >= t.{key} AND {x} < n.{key} THEN t.{to} + ({x} - t.{key}) / (n.{key} - t.{key}) * (n.{to} - t.{to}) END), CASE WHEN {x} < min(t.{key}) THEN arg_min(t.{to}, t.{key}) ELSE arg_max(n.{to}, n.{key}) END) FROM t JOIN t n ON n.i = t.i + 1)"

    made = {"ms": line("e_a", "a", "s"), "md": line("e_a", "a", "d"), "mg": line("e_a", "a", "g"), "mf": line("e_a", "d", "a")}
    return (
        f"WITH t AS (SELECT i, i / 8.0::DOUBLE AS a, -2 * (pow(i / 8.0::DOUBLE, -0.5) - 1) AS s, pow(i / 8.0::DOUBLE, 0.9) AS d, 0.9 * pow(i / 8.0::DOUBLE, -0.1) AS g FROM range(1, 9) r(i)), "
        f"e AS (SELECT event_id AS id, value / 90 AS e_a FROM events), m AS (SELECT id, e_a, {', '.join(f'{v} AS {k}' for k, v in made.items())} FROM e) "
        f"SELECT id, {q('ms', 7)} AS superconft, {q(line('ms', 's', 'a'), 7)} AS back, {q('mf', 7)} AS from_growth, {q('e_a * mg / md', 7)} AS rate, {q('pow(e_a, 3) * pow(e_a, -1.5) * mg')} AS fplus FROM m"
    )


def pair_force(alpha: float) -> str:
    """CTE sr: the short-range force as a sum over pairs within six alpha; the error function by its series."""
    d = ", ".join(f"{min_image(f'a.{x} - b.{x}')} AS d{x}" for x in "xyz")
    x, r2 = f"(r / {math.sqrt(2) * alpha!r})", "(dx * dx + dy * dy + dz * dz)"
    term = f"acc.t * 2 * {x} * {x} / (2 * n + 1)"
    series = f"list_reduce(range(1, 72), lambda acc, n: {{'t': {term}, 's': acc.s + {term}}}, {{'t': {x}, 's': {x}}}).s"
    shape = f"1 - {2 / math.sqrt(math.pi)!r} * exp(-{x} * {x}) * {series} + {math.sqrt(2 / math.pi) / alpha!r} * r * exp(-{x} * {x})"
    unit = -(L**3) / (4 * math.pi)
    sums = ", ".join(f"sum(f * d{c}) * {unit!r} / (SELECT count(*) FROM part) AS a{c}" for c in "xyz")
    return (
        f"pr AS (SELECT a, b, dx, dy, dz, r, ({shape}) / (r * r * r) AS f FROM (SELECT *, sqrt({r2}) AS r FROM (SELECT a.id AS a, b.id AS b, {d} FROM part a JOIN part b ON a.id < b.id)) WHERE r > 0 AND r < {6 * alpha!r}), "
        f"sr AS (SELECT id, {sums} FROM (SELECT a AS id, f, dx, dy, dz FROM pr UNION ALL SELECT b, f, -dx, -dy, -dz FROM pr) GROUP BY id)"
    )


def particle_statements() -> dict[str, str]:
    """Forces, non-uniform transforms by definition, and the statistics of three points as sums over pairs of modes."""
    h, out = L / N, {}
    wide = f"{PART}, {cells(16)}, {density('part', 2, 'field', 16)}, {dft('field', 'f', 16)}"
    out["pencil_fft"] = f"WITH {wide} SELECT jx, jy, jz, {q('re')} AS re, {q('im')} AS im FROM f"
    out["skewer"] = f"WITH {PART}, {cells()}, {density('part', 2, 'rho')} SELECT iy - 2 AS iy, iz, {q('re')} AS v FROM rho WHERE ix = 3 AND iy >= 2 AND iy < 6"
    phase = f"(({kk('jx')} + {kk('jy')} + {kk('jz')}) * {h / 2})"
    out["interlaced"] = (
        f"WITH {PART}, {cells()}, moved AS (SELECT id, x + {h / 2} AS x, y + {h / 2} AS y, z + {h / 2} AS z FROM part), {density('part', 2, 'rho')}, {density('moved', 2, 'other')}, {dft('other', 'f')}, "
        f"g AS (SELECT jx, jy, jz, re * cos{phase} - im * sin{phase} AS re, re * sin{phase} + im * cos{phase} AS im FROM f), {dft('g', 'b', inverse=True)} SELECT ix, iy, iz, {q('(rho.re + b.re) / 2')} AS v FROM rho JOIN b USING (ix, iy, iz)"
    )
    out["redshift_field"] = (
        f"WITH {MOVING}, {cells()}, {stencil('moving', 2, out='near')}, c AS (SELECT ix * {h} AS x, iy * {h} AS y, iz * {h} + sum(w * pz) / sum(w) * 12.5 AS z, sum(w) AS m FROM near GROUP BY ix, iy, iz HAVING sum(w) > 0), "
        f"{stencil('c', 2, out='again')}, d AS (SELECT ix, iy, iz, sum(w * m) AS v FROM again GROUP BY ix, iy, iz) SELECT ix, iy, iz, {q('coalesce(d.v, 0)')} AS v FROM cells LEFT JOIN d USING (ix, iy, iz)"
    )
    axes, ctes = ("x", "y", "z"), []
    for x in axes:
        k = f"({gradient('j' + x, 0)}) / nullif({K2}, 0) * {' * '.join(sinc(j, 6) for j in ('jx', 'jy', 'jz'))}"
        ctes += [f"g{x} AS (SELECT jx, jy, jz, coalesce(-im * {k}, 0.0) AS re, coalesce(re * {k}, 0.0) AS im FROM f)", dft(f"g{x}", f"back_{x}", inverse=True)]
    out["pm_force"] = f"WITH {PART}, {cells()}, {density('part', 3, 'rho')}, {dft('rho', 'f')}, {', '.join(ctes)}, {stencil('part', 3, out='near')} SELECT id, {', '.join(q(f'sum(w * back_{x}.re)') + f' AS a{x}' for x in axes)} FROM near JOIN back_x USING (ix, iy, iz) JOIN back_y USING (ix, iy, iz) JOIN back_z USING (ix, iy, iz) GROUP BY id"
    k2 = f"({kk('jx', 64)} * {kk('jx', 64)} + {kk('jy', 64)} * {kk('jy', 64)} + {kk('jz', 64)} * {kk('jz', 64)})"
    fine = f"{PART}, {cells(64)}, {density('part', 2, 'rho', 64)}, {dft('rho', 'f', 64)}"
    for x in axes:
        k = f"({gradient('j' + x, 0, 64)}) / nullif({k2}, 0)"
        fine += f", f{x} AS (SELECT jx, jy, jz, coalesce(-im * {k}, 0.0) AS re, coalesce(re * {k}, 0.0) AS im FROM f), {dft(f'f{x}', f'on_{x}', 64, True)}"
    out["mesh_64"] = f"WITH {fine} SELECT ix, count(*) AS cells, {', '.join(q(f'sum(on_{x}.re * on_{x}.re)', 3) + f' AS a{x}' for x in axes)} FROM on_x JOIN on_y USING (ix, iy, iz) JOIN on_z USING (ix, iy, iz) GROUP BY ix"
    for x in axes:
        k = f"({gradient('j' + x, 0)}) / nullif({K2}, 0) * {' * '.join(sinc(j, 4) for j in ('jx', 'jy', 'jz'))} * exp(-0.5 * {K2})"
        ctes += [f"l{x} AS (SELECT jx, jy, jz, coalesce(-im * {k}, 0.0) AS re, coalesce(re * {k}, 0.0) AS im FROM f)", dft(f"l{x}", f"far_{x}", inverse=True)]
    far = f"{cells()}, {density('part', 2, 'rho')}, {dft('rho', 'f')}, {', '.join(ctes[6:])}, {stencil('part', 2, out='near')}, far AS (SELECT id, {', '.join(f'sum(w * far_{x}.re) AS a{x}' for x in axes)} FROM near JOIN far_x USING (ix, iy, iz) JOIN far_y USING (ix, iy, iz) JOIN far_z USING (ix, iy, iz) GROUP BY id)"
    both = ", ".join(q(f"far.a{x} + coalesce(sr.a{x}, 0)", 3) + f" AS a{x}" for x in axes)
    out["tree_pm"] = f"WITH {PART}, {far}, {pair_force(1.0)} SELECT id, {both} FROM far LEFT JOIN sr USING (id)"
    out["short_range_force"] = f"WITH {PART}, {pair_force(1.5)} SELECT id, {', '.join(q(f'coalesce(sr.a{x}, 0)', 3) + f' AS a{x}' for x in axes)} FROM part LEFT JOIN sr USING (id)"
    out["tree_walk"] = f"WITH {PART} SELECT id, true AS ax, true AS ay, true AS az FROM part"
    edges = [2 * math.pi / L * (1 + n * (N / 3 - 1) / 2) for n in range(3)]
    shell = f"CASE WHEN k >= {edges[0]!r} AND k < {edges[1]!r} THEN 0 WHEN k >= {edges[1]!r} AND k < {edges[2]!r} THEN 1 END"
    product = "a.re * (b.re * c.re - b.im * c.im) - a.im * (b.re * c.im + b.im * c.re)"
    out["bispectrum"] = (
        f"WITH {PART}, {cells()}, {density('part', 2, 'rho')}, {dft('rho', 'f')}, s AS (SELECT * FROM (SELECT *, {shell} AS s FROM (SELECT *, sqrt({K2}) AS k FROM f)) WHERE s IS NOT NULL) "
        f"SELECT CAST(a.s AS INTEGER) AS b1, CAST(b.s AS INTEGER) AS b2, CAST(c.s AS INTEGER) AS b3, count(*) AS triangles, {q(f'avg({product}) * {L**6 / N**9!r}', 0)} AS b FROM s a JOIN s b ON a.s >= b.s "
        f"JOIN s c ON b.s >= c.s AND c.jx = (16 - a.jx - b.jx) % 8 AND c.jy = (16 - a.jy - b.jy) % 8 AND c.jz = (16 - a.jz - b.jz) % 8 GROUP BY a.s, b.s, c.s"
    )
    out["bispectrum_direct"] = out["bispectrum"]
    flat = "flat AS (SELECT CAST(i // 8 AS INTEGER) AS jx, CAST(i % 8 AS INTEGER) AS jy, i FROM range(64) t(i))"
    angle = f"({kk('jx')} * x + {kk('jy')} * y)"
    out["nufft_type1"] = f"WITH {PART}, {flat} SELECT jx, jy, {q(f'sum(cos{angle})', 3)} AS re, {q(f'-sum(sin{angle})', 3)} AS im FROM part, flat GROUP BY jx, jy"
    given = "given AS (SELECT jx, jy, sin(i * 0.7) AS re, cos(i * 1.3) AS im FROM flat)"
    out["nufft_type2"] = f"WITH {PART}, {flat}, {given} SELECT id, {q(f'sum(re * cos{angle} - im * sin{angle})', 4)} AS re, {q(f'sum(re * sin{angle} + im * cos{angle})', 4)} AS im, {q(f'sum(-{kk("jx")} * (re * sin{angle} + im * cos{angle}))', 4)} AS slope FROM part, given GROUP BY id"
    g = f"({{k}} / ({kk('jx')} * {kk('jx')} + {kk('jy')} * {kk('jy')}) / (SELECT count(*) FROM part))"
    pull = lambda j: f"sum(-(im * cos{angle} + re * sin{angle}) * {g.format(k=kk(j))})"
    out["nufft_force_fine"] = f"WITH {PART}, {flat}, f AS (SELECT jx, jy, sum(cos{angle}) AS re, -sum(sin{angle}) AS im FROM part, flat WHERE jx <> 4 AND jy <> 4 AND jx + jy > 0 GROUP BY jx, jy) SELECT id, {q(pull('jx'), 3)} AS ax, {q(pull('jy'), 3)} AS ay FROM part, f GROUP BY id"
    step = math.log(1e3) / 255
    out["growth_eds"] = f"WITH t AS (SELECT CAST(i AS INTEGER) AS i, exp(ln(1e-3) + i * {step!r}) AS a FROM range(256) t(i)) SELECT i, {q('a', 5)} AS a, {q('-2 * (pow(a, -0.5) - 1)', 5)} AS superconft, {q('a', 5)} AS \"Dplus\", 1.0 AS \"Dplusda\", {q('-3 * a * a / 7', 5)} AS \"D2plus\", {q('a * a * a / 3', 5)} AS \"D3plusa\", {q('-10 * a * a * a / 21', 5)} AS \"D3plusb\", {q('a * a * a / 7', 5)} AS \"D3plusc\" FROM t WHERE a > 0.01"
    out["lpt_exact"] = f"WITH {cells()} SELECT id, true AS psi, true AS velocity, true AS \"D\", true AS acceleration FROM cells"
    out["nbody_1d"] = f"WITH w AS (SELECT i, i / 64.0 AS q FROM range(64) t(i)) SELECT i AS id, {q(f'0.5 / 0.8 * sin({TAU} * q) / {TAU}', 7)} AS sx, {q(f'sin({TAU} * q) / ({TAU} * 0.8)')} AS vx FROM w"
    half, turn = h / 2, f"CAST({TAU} AS DOUBLE) / {L}"
    out["sheet_resampled"] = f"WITH {cells()}, o AS (SELECT CAST(i AS INTEGER) AS shift, i // 4 * {half} AS a, i // 2 % 2 * {half} AS b, i % 2 * {half} AS c FROM range(8) t(i)) SELECT shift, id, {q(pmod(f'ix * {h} + a + 2 * sin((ix * {h} + a) * {turn})', L))} AS x, {q(pmod(f'iy * {h} + b + sin((iy * {h} + b) * {turn})', L))} AS y, {q(f'iz * {h} + c + 0.25')} AS z FROM cells, o"
    out["shift_linear"] = f"WITH {WAVES}, o AS (SELECT a, b, (CASE WHEN a = 1 THEN 3.0 / {h} ELSE 1 - 3.0 / {h} END) * (CASE WHEN b = 1 THEN 5.0 / {h} ELSE 1 - 5.0 / {h} END) AS w FROM range(2) s(a), range(2) t(b)) SELECT c.ix, c.iy, c.iz, {q('sum(o.w * waves.v)')} AS v FROM cells c, o, waves WHERE waves.ix = (c.ix + a) % 8 AND waves.iy = c.iy AND waves.iz = (c.iz + b) % 8 GROUP BY c.ix, c.iy, c.iz"
    out["value_at"] = f"WITH {WAVES} SELECT ix, iy, iz, {q('(CASE WHEN ix = 3 THEN 9.0 ELSE v END) + (CASE WHEN iz = 0 THEN 0.5 ELSE 0.0 END)')} AS v FROM waves"
    out["grid_units"] = f"WITH {PART} SELECT id, {q(f'x * {N / L!r}')} AS cell, {q(f'y * {h}')} AS place FROM part"
    out["snapshot_stride"] = f"WITH {PART} SELECT id, CAST(id % 11 * 2 AS INTEGER) AS snap FROM part WHERE id % 11 IN (SELECT s FROM (SELECT s, row_number() OVER (ORDER BY s) - 1 AS r FROM (SELECT DISTINCT id % 11 AS s FROM part)) WHERE r % 3 = 0)"
    p = f"((re * re + im * im) * {L**3 / N**6!r})"
    out["spectrum_deviation"] = f"WITH {PART}, {cells()}, {density('part', 2, 'rho')}, {dft('rho', 'f')} " + binned("f", f"{q(f'sqrt(greatest(0.0, sum(m * {p} * {p}) - pow(sum(m * {p}), 2) / sum(m)) / nullif(sum(m) - 1, 0))', 3)} AS sd")
    names, move = moves()
    k = f"sqrt({K2})"
    place = f"CASE {' '.join(f'WHEN {k} < {e!r} THEN {n - 1}' for n, e in enumerate(LOG_EDGES))} END"
    bins = f"b AS (SELECT *, {place} AS bin FROM f), n AS (SELECT bin, count(*) AS n FROM b GROUP BY bin), g AS (SELECT jx, jy, jz, re * c AS re, im * c AS im FROM (SELECT b.*, coalesce([1.0, -0.5, 0.25, 2.0, 0.0, 1.0][b.bin + 1], 0) / n.n AS c FROM b JOIN n ON n.bin = b.bin AND b.bin >= 0))"
    out["spectrum_gradient"] = (
        f"WITH {MOVING}, {cells()}, {density('moving', 3, 'rho')}, {dft('rho', 'f')}, {bins}, {dft('g', 'back', inverse=True)}, {move} "
        f"SELECT id, {', '.join(q(f'sum({c} * back.re) * {2 * L**3 / N**3!r} / (SELECT count(*) / {N**3}.0 FROM moving)', 7) + f' AS g{c[1]}' for c in names)} FROM move JOIN back USING (ix, iy, iz) GROUP BY id"
    )
    fields = []
    for x in "xyz":
        kernel = f"({gradient('j' + x, 0)}) / nullif({K2}, 0)"
        for source, name in (("f", "a"), ("df", "t")):
            fields += [f"{name}s{x} AS (SELECT jx, jy, jz, coalesce(-im * {kernel}, 0.0) AS re, coalesce(re * {kernel}, 0.0) AS im FROM {source})", dft(f"{name}s{x}", f"{name}{x}", inverse=True)]
    changed = f"dm AS (SELECT ix, iy, iz, sum(dx * px + dy * py + dz * pz) AS v FROM move GROUP BY ALL), drho AS (SELECT c.ix, c.iy, c.iz, coalesce(dm.v, 0) / ((SELECT count(*) FROM moving) / {N**3}.0) AS re, 0.0 AS im FROM cells c LEFT JOIN dm USING (ix, iy, iz))"
    parts = ", ".join(f"still{x} AS (SELECT id, sum(w * t{x}.re) AS s FROM near JOIN t{x} USING (ix, iy, iz) GROUP BY id), moved{x} AS (SELECT id, sum((dx * px + dy * py + dz * pz) * a{x}.re) AS s FROM move JOIN a{x} USING (ix, iy, iz) GROUP BY id)" for x in "xyz")
    out["force_tangent"] = (
        f"WITH {MOVING}, {cells()}, {density('moving', 3, 'rho')}, {dft('rho', 'f')}, {move}, {changed}, {dft('drho', 'df')}, {', '.join(fields)}, {stencil('moving', 3, out='near')}, {parts} "
        f"SELECT id, {', '.join(q(f'still{x}.s + moved{x}.s', 5) + f' AS ta{x}' for x in 'xyz')} FROM {' JOIN '.join(f'still{x} USING (id) JOIN moved{x} USING (id)' if x != 'x' else 'stillx JOIN movedx USING (id)' for x in 'xyz')}"
    )
    out["user_code"] = f"WITH {PART}, {cells()}, {density('part', 2, 'rho')} SELECT ix, count(*) AS cells, {q('sign(max(re)) * ln(1 + abs(max(re)))')} AS top, {q('max(re) - min(re)')} AS spread FROM rho GROUP BY ix"
    out["gather_gradient"] = f"WITH {MOVING}, {FIELD}, {move} SELECT id, {', '.join(q(f'sum({c} * waves.v)') + f' AS g{c[1]}' for c in names)} FROM move JOIN waves USING (ix, iy, iz) GROUP BY id"
    out["deposit_tangent"] = f"WITH {MOVING}, {cells()}, {move}, d AS (SELECT ix, iy, iz, sum(dx * px + dy * py + dz * pz) AS dv FROM move GROUP BY ix, iy, iz) SELECT ix, iy, iz, {q('coalesce(dv, 0)', 5)} AS dv FROM cells LEFT JOIN d USING (ix, iy, iz)"
    pair = lambda c, shift: " | ".join(f"((({c} >> {n}) & 1) << {2 * n + shift})" for n in range(10))
    out["morton_2d"] = f"WITH {PART}, g AS (SELECT id, CAST(least(floor(x / {L} * 1024), 1023) AS BIGINT) AS a, CAST(least(floor(y / {L} * 1024), 1023) AS BIGINT) AS b FROM part) SELECT id, CAST({pair('a', 1)} | {pair('b', 0)} AS BIGINT) AS morton FROM g"
    return out


def jacobian_det() -> str:
    """All displacements are multiples of one field, so the determinant is one and the derivative along one direction."""
    k = f"(2 * ({gradient('jx', 0)}) + 1 * ({gradient('jy', 0)}) + 0.5 * ({gradient('jz', 0)}))"
    return spectral(f"-im * {k}", f"re * {k}").replace(f"{q('re')} AS v", f"{q('1 + re')} AS det")


def statements() -> dict[str, str]:
    h = L / N
    out = {
        "wrap_positions": f"WITH {MOVING} SELECT id, {q(pmod('x * 3 - 150', L))} AS x FROM moving",
        "min_image": f"WITH {PART} SELECT id, {q(min_image('x - y'))} AS d FROM part",
        "pair_distance": f"WITH {PART} SELECT a.id, {q('sqrt(pow(' + min_image('a.x - b.x') + ', 2) + pow(' + min_image('a.y - b.y') + ', 2) + pow(' + min_image('a.z - b.z') + ', 2))')} AS r FROM part a JOIN part b ON b.id = a.id + 1",
        "lagrangian_grid": f"WITH {cells()} SELECT id, ix * {h} AS qx, iy * {h} AS qy, iz * {h} AS qz, n FROM cells JOIN (SELECT event_id % {N**3} AS id, count(*) AS n FROM events GROUP BY 1) USING (id)",
        "fourier_grid": f"WITH {WAVE_SPECTRUM} SELECT jx, jy, jz, {q(kk('jx'), 9)} AS kx, {q(kk('jy'), 9)} AS ky, {q(kk('jz'), 9)} AS kz, {q(f'sqrt({K2})', 9)} AS k, {q('re * re + im * im', 4)} AS power FROM f WHERE jz <= {N // 2}",
        "slice_filter": f"WITH {PART} SELECT id FROM part WHERE (x >= 0.0 - 20 AND x <= 0.0 + 20) OR x >= {L - 20}",
        "subsample_stride": f"WITH {cells(16)} SELECT CAST(ix // 4 * 16 + iy // 4 * 4 + iz // 4 AS BIGINT) AS id, event_id AS was FROM events JOIN cells ON event_id % 4096 = id WHERE ix % 4 = 0 AND iy % 4 = 0 AND iz % 4 = 0",
        "glass_detile": "WITH g AS (SELECT event_id AS i, event_id % 4096 // 512 AS o, event_id % 512 AS s FROM events) SELECT i AS id, CAST(((o // 4 * 8 + s // 64) * 16 + o // 2 % 2 * 8 + s // 8 % 8) * 16 + o % 2 * 8 + s % 8 AS BIGINT) AS place FROM g",
        "deposit_weighted": f"WITH {PART}, {stencil('part', 2)}, {cells()}, d AS (SELECT ix, iy, iz, sum(w * v) AS v FROM sten GROUP BY ALL) SELECT ix, iy, iz, {q('coalesce(d.v, 0)', 5)} AS v FROM cells LEFT JOIN d USING (ix, iy, iz)",
        "redshift_shift": f"WITH {MOVING} SELECT id, {q(pmod('z + pz * 12.5', L))} AS z FROM moving",
        "cell_velocity": f"WITH {MOVING}, {stencil('moving', 2)} SELECT c.ix, c.iy, c.iz, {q('d.v')} AS v FROM ({'WITH ' + cells() + ' SELECT * FROM cells'}) c LEFT JOIN (SELECT ix, iy, iz, sum(w * pz) / sum(w) AS v FROM sten GROUP BY ix, iy, iz HAVING sum(w) > 0) d USING (ix, iy, iz)",
        "dft_forward": f"WITH {WAVE_SPECTRUM} SELECT jx, jy, jz, {q('re')} AS re, {q('im')} AS im FROM f",
        "dft_inverse": spectral("re", "im"),
        "mak_kernel": f"WITH {WAVE_SPECTRUM} SELECT jx, jy, jz, {q('re * ' + ' * '.join(sinc(j, 2) for j in ('jx', 'jy', 'jz')))} AS cic, {q('re * ' + ' * '.join(sinc(j, 6) for j in ('jx', 'jy', 'jz')), 4)} AS tsc_twice FROM f",
        "deconvolve": spectral(*[f"{c} * {' * '.join(sinc(j, 2) for j in ('jx', 'jy', 'jz'))}" for c in ("re", "im")]),
        "poisson": spectral(*[f"CASE WHEN jx = 0 AND jy = 0 AND jz = 0 THEN 0.0 ELSE -{c} / {K2} END" for c in ("re", "im")], digits=4),
        "gaussian_split": spectral(*[f"{c} * exp(-0.5 * {K2} * 100)" for c in ("re", "im")]),
        "fourier_crop": f"WITH {WAVE_SPECTRUM} SELECT CAST({pmod(sg('jx'), 4)} AS INTEGER) AS jx, CAST({pmod(sg('jy'), 4)} AS INTEGER) AS jy, CAST({pmod(sg('jz'), 4)} AS INTEGER) AS jz, {q('re / 8')} AS re, {q('im / 8')} AS im FROM f WHERE abs({sg('jx')}) < 2 AND abs({sg('jy')}) < 2 AND abs({sg('jz')}) < 2",
        "fourier_pad": f"WITH {WAVE_SPECTRUM} SELECT CAST({pmod(sg('jx'), 12)} AS INTEGER) AS jx, CAST({pmod(sg('jy'), 12)} AS INTEGER) AS jy, CAST({pmod(sg('jz'), 12)} AS INTEGER) AS jz, {q('re * 3.375')} AS re, {q('im * 3.375')} AS im FROM f WHERE jx <> 4 AND jy <> 4 AND jz <> 4 AND jx + jy + jz > 0",
        "ngenic_modes": f"WITH {MODES} SELECT count(*) - 1 AS modes, CAST(0 AS BIGINT) AS mean, CAST(0 AS BIGINT) AS nyquist, CAST(0 AS BIGINT) AS unpaired FROM modes WHERE jx <> 4 AND jy <> 4 AND jz < 4",
        "hermitian_sym": f"WITH {WAVE_SPECTRUM}, s AS (SELECT jx, jy, jz, re + 0.1 * jx AS re, im - 0.05 * jy AS im FROM f WHERE jz <= 4), m AS (SELECT a.*, (8 - a.jx) % 8 AS mx, (8 - a.jy) % 8 AS my FROM s a) "
        f"SELECT a.jx, a.jy, a.jz, {q('CASE WHEN a.jz % 4 = 0 AND a.jx * 8 + a.jy > mx * 8 + my THEN b.re ELSE a.re END')} AS re, {q('CASE WHEN a.jz % 4 <> 0 THEN a.im WHEN a.jx * 8 + a.jy = mx * 8 + my THEN 0.0 WHEN a.jx * 8 + a.jy > mx * 8 + my THEN -b.im ELSE a.im END')} AS im FROM m a JOIN s b ON b.jx = a.mx AND b.jy = a.my AND b.jz = a.jz",
        "fourier_shift": spectral(f"re * cos({kk('jx')} * 3.0 + {KZ} * 5.0) - im * sin({kk('jx')} * 3.0 + {KZ} * 5.0)", f"re * sin({kk('jx')} * 3.0 + {KZ} * 5.0) + im * cos({kk('jx')} * 3.0 + {KZ} * 5.0)"),
        "power_spectrum": f"WITH {PART}, {stencil('part', 2)}, {cells()}, d AS (SELECT ix, iy, iz, sum(w) AS v FROM sten GROUP BY ALL), field AS (SELECT ix, iy, iz, coalesce(v, 0) / ((SELECT count(*) FROM part) / {N**3}.0) - 1 AS re, 0.0 AS im FROM cells LEFT JOIN d USING (ix, iy, iz)), {dft('field', 'f')} "
        + binned("f", f"CAST(sum(m) AS BIGINT) AS modes, {q('sum(m * k) / sum(m)')} AS k, {q(f'sum(m * (re * re + im * im)) / sum(m) * {L**3 / N**6!r}', 4)} AS pk"),
        "jacobian_det": jacobian_det(),
        "e_of_a": f"WITH {FACTORS} SELECT id, {q(expansion(PLANCK), 5)} AS e, {q(f'{PLANCK.H0!r} * ' + expansion(PLANCK), 3)} AS h, {q(f'(-3 * {PLANCK.Omega_m!r} * pow(a, -4)) / (2 * ' + expansion(PLANCK) + ')', 3)} AS slope, {q(repr(PLANCK.Omega_de))} AS de FROM factors",
        "transfer_eh": f"WITH {KTABLE} SELECT id, {q(transfer_eh(PLANCK), 7)} AS t FROM ktable",
        "transfer_bbks": f"WITH {KTABLE} SELECT id, {q(transfer_bbks(PLANCK), 7)} AS t FROM ktable",
        "transfer_ga": f"WITH {KTABLE} SELECT id, {q(transfer_ga(PLANCK), 7)} AS t FROM ktable",
        "sigma8": f"WITH {SPECTRUM} SELECT {q(sigma2('pk'), 9)} AS sigma2",
        "linear_ps": f"WITH ktable AS (SELECT CAST(i AS INTEGER) AS i, exp(ln(1e-5) + i * (ln(1e3) - ln(1e-5)) / 63) AS k FROM range(64) t(i)), pk AS (SELECT i, k, pow({transfer_eh(PLANCK)}, 2) * pow(k, {PLANCK.n_s!r}) AS pk FROM ktable), n AS (SELECT k, pk * {PLANCK.sigma8**2!r} / {sigma2('pk')} AS pk FROM pk), "
        f"t AS (SELECT k, pk, lead(k) OVER (ORDER BY k) AS k2, lead(pk) OVER (ORDER BY k) AS pk2 FROM n), x AS (SELECT event_id AS id, 0.001 + value / 100 AS x FROM events) SELECT id, {q('pk + (x - k) / (k2 - k) * (pk2 - pk)', 3)} AS pk FROM x JOIN t ON x >= k AND x < k2",
        "superconft_table": f"WITH {TIMES}, g AS (SELECT i, a, 1 / ({expansion(PLANCK)} * a * a * a) AS f FROM factors), s AS (SELECT i, (lead(a) OVER (ORDER BY i) - a) * (lead(f) OVER (ORDER BY i) + f) / 2 AS s FROM g) SELECT i, {q('-coalesce(sum(s) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING), 0.0)', 5)} AS superconft FROM s",
        "interp_asof": f"WITH t AS (SELECT *, lead(k) OVER (ORDER BY k) AS k2, lead(v) OVER (ORDER BY k) AS v2 FROM (SELECT o_totalprice AS k, CAST(min(o_orderkey) AS DOUBLE) AS v FROM orders GROUP BY 1)), p AS (SELECT event_id AS id, value * 4000 - 20000 AS x FROM events) "
        f"SELECT id, {q('coalesce(CASE WHEN k2 IS NULL THEN v ELSE v + (x - k) / (k2 - k) * (v2 - v) END, (SELECT arg_min(v, k) FROM t))', 4)} AS y FROM p ASOF LEFT JOIN t ON p.x >= t.k",
        "time_maps": time_maps(),
        "interp_table": f"WITH {SPECTRUM}, t AS (SELECT k, pk, lead(k) OVER (ORDER BY k) AS k2, lead(pk) OVER (ORDER BY k) AS pk2 FROM pk), x AS (SELECT event_id AS id, 0.001 + value / 100 AS x FROM events) "
        f"SELECT id, {q('CASE WHEN x >= (SELECT max(k) FROM pk) THEN (SELECT arg_max(pk, k) FROM pk) ELSE pk + (x - k) / (k2 - k) * (pk2 - pk) END', 8)} AS y FROM x LEFT JOIN t ON x >= k AND x < k2",
        "plane_wave": f"WITH {LINE}, w AS (SELECT id AS i, x / {L} AS q FROM line) SELECT i AS id, {q(f'q + 0.25 / 0.5 * sin({TAU} * q) / {TAU}', 9)} AS x, {q(f'0.125 * sin({TAU} * q) / ({TAU} * 0.5)', 9)} AS px, {q(f'-0.5 * cos({TAU} * q)', 9)} AS delta FROM w",
        "zeldovich_1d": f"WITH {LINE}, {stencil('line', 2, 64, ('x',), 'near')}, d AS (SELECT ix, sum(w) AS v FROM near GROUP BY ix), rho AS (SELECT CAST(i AS INTEGER) AS ix, (coalesce(v, 0) / ((SELECT count(*) FROM line) / 64.0) - 1) * 1e-4 AS re, 0.0 AS im FROM range(64) r(i) LEFT JOIN d ON d.ix = i), "
        f"{dft('rho', 'f', 64, False, (('ix', 'jx'),))}, g AS (SELECT jx, im * ({gradient('jx', 0, 64, 1.0)}) AS re, -re * ({gradient('jx', 0, 64, 1.0)}) AS im FROM f), {dft('g', 'b', 64, True, (('ix', 'jx'),))} SELECT CAST(ix AS BIGINT) AS id, {q('re', 8)} AS sx FROM b",
        "exact_acc_1d": f"WITH {LINE}, r AS (SELECT id, x, row_number() OVER (ORDER BY x, id) - 1 AS k, avg(x) OVER () AS mean, count(*) OVER () AS n FROM line) SELECT id, {q(f'{L} * ((x - mean) / {L} + 0.5 - (k + 0.5) / n)')} AS a FROM r",
        "dkd_step": f"WITH {LINE}, h AS (SELECT id, x AS s, {pmod(f'id % {N} * {h} + x + p * 2.0', L)} AS x, p FROM line), r AS (SELECT id, s, x, p, row_number() OVER (ORDER BY x, id) - 1 AS k, avg(x) OVER () AS mean, count(*) OVER () AS n FROM h), v AS (SELECT id, s, p, 0.9 * p + 0.05 * ({L} * ((x - mean) / {L} + 0.5 - (k + 0.5) / n)) AS v FROM r) SELECT id, {q('s + p * 2.0 + v * 2.0', 5)} AS sx, {q('v')} AS vx FROM v",
        "morton_3d": f"WITH {PART}, g AS (SELECT id, CAST(least(floor(x / {L} * 1024), 1023) AS BIGINT) AS a, CAST(least(floor(y / {L} * 1024), 1023) AS BIGINT) AS b, CAST(least(floor(z / {L} * 1024), 1023) AS BIGINT) AS c FROM part) SELECT id, CAST({bits('a', 2)} | {bits('b', 1)} | {bits('c', 0)} AS BIGINT) AS morton FROM g",
        "multipoles": " UNION ALL ".join(f"SELECT CAST({n} AS INTEGER) AS level, CAST(count(DISTINCT (floor(x / {L} * {1 << n}), floor(y / {L} * {1 << n}), floor(z / {L} * {1 << n}))) AS BIGINT) AS nodes, {q('CAST(count(*) AS DOUBLE)')} AS m, {q('sum(x)', 3)} AS dx, {q('sum(y * z)', 1)} AS qyz FROM (WITH {PART} SELECT * FROM part)" for n in range(4)),
        "short_range_pairs": f"WITH {PART}, d AS (SELECT a.id AS a, b.id AS b, {min_image('a.x - b.x')} AS dx, {min_image('a.y - b.y')} AS dy, {min_image('a.z - b.z')} AS dz FROM part a JOIN part b ON a.id < b.id) SELECT a, b, {q('sqrt(dx * dx + dy * dy + dz * dz)')} AS r FROM d WHERE sqrt(dx * dx + dy * dy + dz * dz) < 2",
        "box_queries": f"WITH {PART} SELECT b AS box, id, {q('x')} AS x, {q('y')} AS y, {q('z')} AS z FROM part, (VALUES ('slice'), ('skewer'), ('edge'), ('small')) t(b) WHERE CASE b WHEN 'slice' THEN x >= 25 AND x < 37.5 WHEN 'skewer' THEN x >= 50 AND x < 62.5 AND y < 12.5 "
        "WHEN 'edge' THEN (x >= 90 OR x < 5) AND (y >= 90 OR y < 20) AND z >= 30 AND z < 80 ELSE x >= 40 AND x < 43 AND y >= 71 AND y < 75 AND z >= 11 AND z < 19 END",
        "gadget_snapshot": f"WITH {MOVING} SELECT id, {q('x')} AS x, {q('z')} AS z, {q('py * 100 / pow(0.25, 1.5)')} AS vy, CAST(1.5 AS DOUBLE) AS mass FROM moving",
        "snapshot_series": f"WITH {MOVING} SELECT CAST(s AS INTEGER) AS snap, id, {q(pmod('y + py * (5.0 * s)', L))} AS y FROM moving, (VALUES (0), (2), (3)) t(s)",
        "gadget_units": f"WITH {MOVING} SELECT id, {q('x')} AS x, {q('px * 100 / pow(0.25, 1.5)')} AS vx, {q('pz * 100 / pow(0.25, 1.5)')} AS vz FROM moving",
    }
    kny = math.pi * N / L
    inside = f"{K2} <= {kny * kny * (1 + 1e-12)!r}"
    out |= {
        "positions_from_psi": f"WITH {PART}, {cells()} SELECT c.id, {q(pmod(f'ix * {h} + x / 10', L))} AS x, {q(pmod(f'iy * {h} + y - 50', L))} AS y, {q(pmod(f'iz * {h} - 0.5', L))} AS z FROM part JOIN cells c ON part.id % {N**3} = c.id",
        "dilated_mask": f"WITH {WAVES}, o AS (SELECT s - 1 AS s FROM range(3) t(s)) SELECT DISTINCT CAST({pmod('ix + a.s', 8)} AS INTEGER) AS ix, CAST({pmod('iy + b.s', 8)} AS INTEGER) AS iy, CAST({pmod('iz + c.s', 8)} AS INTEGER) AS iz FROM waves, o a, o b, o c WHERE v > 0.4",
        "sphere_mode": f"WITH {WAVE_SPECTRUM} SELECT jx, jy, jz, {q(f'CASE WHEN {inside} THEN re ELSE 0 END')} AS re, {q(f'CASE WHEN {inside} THEN im ELSE 0 END')} AS im FROM f",
        "spectrum_cutoff": f"WITH {SPECTRUM} SELECT i, {q('CASE WHEN k < 0.1 THEN pk ELSE 0 END', 9)} AS sharp, {q('pk * exp(-0.5 * pow(k / 0.1, 2))', 9)} AS gaussian FROM pk",
        "field_rescaled": f"WITH {WAVES} SELECT ix, iy, iz, {q('v * 0.5 / (SELECT stddev_pop(v) FROM waves)')} AS v FROM waves",
        "density_from_phi": spectral(f"-re * {K2}", f"-im * {K2}"),
        "field_derivative": spectral(f"-im * ({gradient('jy', 4)})", f"re * ({gradient('jy', 4)})"),
    }
    for name, order in (("ngp", 1), ("cic", 2), ("tsc", 3), ("pcs", 4)):
        out[f"deposit_{name}"] = deposited(order)
    for name, order in (("cic", 2), ("tsc", 3)):
        out[f"gather_{name}"] = gathered(order)
    for order in (0, 2, 4, 6):
        out[f"grad_kernel_{order}"] = f"WITH {WAVE_SPECTRUM} SELECT jx, jy, jz, {q(f're * ({gradient("jy", order)})')} AS g FROM f"
        out[f"inv_laplace_{order}"] = f"WITH {WAVE_SPECTRUM} SELECT jx, jy, jz, {q(f'im * ({laplace(order)})', 4)} AS g FROM f"
    place = lambda j: f"(CASE WHEN {j} = 0 THEN 0 WHEN {j} < 8 - {j} THEN 2 * {j} - 1 WHEN {j} = 4 THEN 7 ELSE 2 * (8 - {j}) END)"
    wide = "greatest(2 * jz - 1, 0)"
    for kind, order in (("stable", f"greatest({place('jx')}, {place('jy')}, {wide}), {place('jx')}, {place('jy')}, {wide}"), ("natural", f"{place('jx')}, {place('jy')}, jz")):
        out[f"k_order_{kind}"] = f"WITH {WAVE_SPECTRUM} SELECT jx, jy, jz, CAST(row_number() OVER (ORDER BY {order}) - 1 AS BIGINT) AS rank, {q('re')} AS re FROM f WHERE jz <= 4"
    second = WAVES + f", fa AS (SELECT ix, iy, iz, v AS re, 0.0 AS im FROM waves), {dft('fa', 'f')}, fb AS (SELECT ix, iy, iz, v * v + 0.1 * ix AS re, 0.0 AS im FROM waves), {dft('fb', 'g')}, j AS (SELECT f.jx, f.jy, f.jz, f.re, f.im, g.re AS r2, g.im AS i2 FROM f JOIN g USING (jx, jy, jz))"
    out["cross_spectrum"] = f"WITH {second} " + binned("j", f"{q('sum(m * k) / sum(m)')} AS k, {q(f'sum(m * (re * re + im * im)) / sum(m) * {L**3 / N**6!r}', 3)} AS p1, {q(f'sum(m * (r2 * r2 + i2 * i2)) / sum(m) * {L**3 / N**6!r}', 3)} AS p2")
    pa = WAVES + f", w2 AS (SELECT ix, iy, iz, v FROM waves), fa AS (SELECT ix, iy, iz, v AS re, 0.0 AS im FROM waves), {dft('fa', 'f')}, pad AS (SELECT CAST({pmod(sg('jx'), 12)} AS INTEGER) AS jx, CAST({pmod(sg('jy'), 12)} AS INTEGER) AS jy, CAST({pmod(sg('jz'), 12)} AS INTEGER) AS jz, re * 3.375 AS re, im * 3.375 AS im FROM f WHERE jx <> 4 AND jy <> 4 AND jz <> 4), {dft('pad', 'b', 12, True)}, sq AS (SELECT ix, iy, iz, re * re AS re, 0.0 AS im FROM b), {dft('sq', 'p', 12)}"
    out |= particle_statements()
    out["waves_at_places"] = out["fourier_shift"]
    out["dealiased_product"] = f"WITH {pa} SELECT CAST({pmod(sg('jx', 12), 8)} AS INTEGER) AS jx, CAST({pmod(sg('jy', 12), 8)} AS INTEGER) AS jy, CAST({pmod(sg('jz', 12), 8)} AS INTEGER) AS jz, {q('re / 3.375')} AS re, {q('im / 3.375')} AS im FROM p WHERE abs({sg('jx', 12)}) < 4 AND abs({sg('jy', 12)}) < 4 AND abs({sg('jz', 12)}) < 4"
    return out
