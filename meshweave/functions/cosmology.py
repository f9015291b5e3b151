"""Background cosmology, growth and linear spectra.

Every formula takes either Columns (m=pyspark.sql.functions) or numpy arrays (m=numpy), so that a query and a table
of a few thousand rows on the driver share one definition. Lengths are in Mpc/h and wave numbers in h/Mpc.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Cosmology:
    """Present densities, h, sigma8 and spectral index; curvature and the equation of state w0 + wa (1 - a)."""

    Omega_c: float
    Omega_b: float
    h: float
    n_s: float
    sigma8: float
    Omega_k: float = 0.0
    w0: float = -1.0
    wa: float = 0.0

    @property
    def Omega_m(self) -> float:
        return self.Omega_c + self.Omega_b

    @property
    def Omega_de(self) -> float:
        return 1.0 - self.Omega_m - self.Omega_k

    @property
    def H0(self) -> float:
        return 100.0 * self.h

    @property
    def is_eds(self) -> bool:
        return abs(self.Omega_m - 1) < 1e-12 and abs(self.Omega_de) < 1e-12

    def updated(self, **changes) -> Cosmology:
        return replace(self, **changes)


# Published parameter sets, as (Omega_c, Omega_b, h, n_s, sigma8).
PLANCK15 = Cosmology(0.2589, 0.04860, 0.6774, 0.9667, 0.8159)
PLANCK18 = Cosmology(0.259622, 0.0488911, 0.67742, 0.96822, 0.8105)
CAMELS_CV = Cosmology(0.251, 0.049, 0.6711, 0.9624, 0.8)
QUIJOTE = Cosmology(0.2685, 0.049, 0.6711, 0.9624, 0.834)
NAMED = {"Planck15": PLANCK15, "Planck18EEBAOSN": PLANCK18, "CamelsCV": CAMELS_CV, "Quijote": QUIJOTE}
EDS = Cosmology(0.8, 0.2, 0.7, 1.0, 0.8)


def w(c: Cosmology, a):
    return c.w0 + c.wa * (1 - a)


def omega_de(c: Cosmology, a, m=F):
    """Dark-energy density in units of today's critical density."""
    return c.Omega_de * a ** (-3 * (1 + c.w0 + c.wa)) * m.exp((a - 1) * (3 * c.wa))


def expansion(c: Cosmology, a, m=F):
    """E(a) = H(a) / H0."""
    return m.sqrt(c.Omega_m * a**-3.0 + c.Omega_k * a**-2.0 + omega_de(c, a, m))


def expansion_slope(c: Cosmology, a, m=F):
    """dE/da."""
    half = -3 * c.Omega_m * a**-4.0 - 2 * c.Omega_k * a**-3.0 - 3 * (1 + w(c, a)) * omega_de(c, a, m) / a
    return half / (2 * expansion(c, a, m))


def hubble(c: Cosmology, a, m=F):
    return c.H0 * expansion(c, a, m)


# --- linear spectra -------------------------------------------------------------------------------------------------


def primordial(k, n_s: float, amplitude: float = 1.0):
    return amplitude * k**n_s


def transfer_bbks(c: Cosmology, k, m=F, neff: float = 3.046):
    """Bardeen, Bond, Kaiser and Szalay 1986."""
    radiation = (1 + neff * 7 / 8 * (4 / 11) ** (4 / 3)) / 1.68
    q = k * (math.sqrt(radiation) / (c.Omega_c * c.h**2))
    x = 2.34 * q
    return m.log(1 + x) / x * (1 + 3.89 * q + (16.1 * q) ** 2 + (5.46 * q) ** 3 + (6.71 * q) ** 4) ** -0.25


def transfer_genetic(c: Cosmology, k, m=F):
    """Fit by a genetic algorithm, arXiv:2211.06393."""
    x = k / (c.Omega_c * c.h**2)
    return (1 + 59.0998 * x**1.49177 + 4658.01 * x**4.02755 + 3170.79 * x**6.06 + 150.089 * x**7.28478) ** -0.25


def transfer_eisenstein_hu(c: Cosmology, k, m=F, t_cmb: float = 2.72548):
    """Eisenstein and Hu 1998 with acoustic oscillations; what depends on parameters alone is folded here."""
    om, ob, fb, t2 = c.Omega_m * c.h**2, c.Omega_b * c.h**2, c.Omega_b / c.Omega_m, (t_cmb / 2.7) ** 2
    z_eq, k_eq = 2.5e4 * om / t2**2, 0.0746 * om / t2 / c.h
    drag = 1 + 0.313 * om**-0.419 * (1 + 0.607 * om**0.674) * ob ** (0.238 * om**0.223)
    z_d = 1291 * om**0.251 / (1 + 0.659 * om**0.828) * drag
    r_d, r_eq = (31.5e3 * ob / t2**2 / z for z in (1 + z_d, z_eq))
    s = 2 / (3 * k_eq) * math.sqrt(6 / r_eq) * math.log((math.sqrt(1 + r_d) + math.sqrt(r_d + r_eq)) / (1 + math.sqrt(r_eq)))
    silk = 1.6 * ob**0.52 * om**0.73 * (1 + (10.4 * om) ** -0.95) / c.h
    alpha_c = ((46.9 * om) ** 0.67 * (1 + (32.1 * om) ** -0.532)) ** -fb * ((12 * om) ** 0.424 * (1 + (45 * om) ** -0.582)) ** -(fb**3)
    beta_c = 1 / (1 + 0.944 / (1 + (458 * om) ** -0.708) * ((1 - fb) ** ((0.395 * om) ** -0.0266) - 1))
    y = (1 + z_eq) / (1 + z_d)
    root = math.sqrt(1 + y)
    alpha_b = 2.07 * k_eq * s * (1 + r_d) ** -0.75 * y * (-6 * root + (2 + 3 * y) * math.log((root + 1) / (root - 1)))
    beta_b = 0.5 + fb + (3 - 2 * fb) * math.sqrt((17.2 * om) ** 2 + 1)
    q, ks = k / (13.41 * k_eq), k * s

    def pressureless(alpha: float, beta: float):
        log = m.log(math.e + 1.8 * beta * q)
        return log / (log + (14.2 / alpha + 386 / (1 + 69.9 * q**1.08)) * q**2)

    f = 1 / (1 + (ks / 5.4) ** 4)
    cold = f * pressureless(1.0, beta_c) + (1 - f) * pressureless(alpha_c, beta_c)
    x = ks / (1 + (8.41 * om**0.435 / ks) ** 3) ** (1 / 3)
    baryons = m.sin(x) / x * (pressureless(1.0, 1.0) / (1 + (ks / 5.2) ** 2) + alpha_b / (1 + (beta_b / ks) ** 3) * m.exp(-((k / silk) ** 1.4)))
    return fb * baryons + (1 - fb) * cold


TRANSFER = {"Eisenstein-Hu": transfer_eisenstein_hu, "BBKS": transfer_bbks, "GeneticAlgorithm": transfer_genetic}


def cutoff(k, kind: str | None, k0: float):
    """Factor on the spectrum: none, sharp (k < k0) or gaussian."""
    if kind is None:
        return F.lit(1.0)
    return {"sharp": F.when(k < k0, 1.0).otherwise(0.0), "gaussian": F.exp(-0.5 * (k / k0) ** 2)}[kind]


def top_hat(x, m=F):
    """Fourier transform of a ball of radius 1."""
    return 3 * (m.sin(x) - x * m.cos(x)) / x**3.0


def sigma_squared(pk: DataFrame, radius: float = 8.0) -> DataFrame:
    """One row sigma2: variance of the density in balls, trapezoid in ln k over a table k, pk of some thousand rows."""
    f = pk.select("k", (F.col("k") ** 3 * F.col("pk") * top_hat(F.col("k") * radius) ** 2).alias("f"))
    by_k = Window.orderBy("k")
    step = f.select(((F.lead("f").over(by_k) + F.col("f")) / 2 * (F.log(F.lead("k").over(by_k)) - F.log("k"))).alias("s"))
    return step.agg((F.sum("s") / (2 * math.pi**2)).alias("sigma2"))


def k_grid(spark: SparkSession, k_min: float, k_max: float, modes: int) -> DataFrame:
    """i, k: geometrically spaced wave numbers."""
    step = (math.log(k_max) - math.log(k_min)) / (modes - 1)
    return spark.range(modes).select(F.col("id").cast("int").alias("i"), F.exp(F.lit(math.log(k_min)) + F.col("id") * step).alias("k"))


def linear_spectrum(spark: SparkSession, c: Cosmology, box: float, n: int, dim: int = 3, transfer: str = "Eisenstein-Hu", modes: int = 1000, cut: str | None = None, k0: float = 1.0) -> DataFrame:
    """i, k, pk at a = 1: transfer^2 k^n_s normalised to sigma8, over a range that holds every mode of the box."""
    low, high = min(math.pi / box, 1e-5), max(2 * math.pi * n / box * math.sqrt(dim), 1e3)
    raw = k_grid(spark, low, high, modes).withColumn("pk", TRANSFER[transfer](c, F.col("k")) ** 2 * primordial(F.col("k"), c.n_s))
    return normalised(raw, c.sigma8).withColumn("pk", F.col("pk") * cutoff(F.col("k"), cut, k0))


def normalised(pk: DataFrame, sigma8: float) -> DataFrame:
    """The table scaled to sigma8; the scale is a one-row table joined on."""
    return pk.join(F.broadcast(sigma_squared(pk)), how="cross").withColumn("pk", F.col("pk") * (sigma8**2) / F.col("sigma2")).drop("sigma2")


# --- growth and time ------------------------------------------------------------------------------------------------



def growth(c: Cosmology, a: np.ndarray) -> dict[str, np.ndarray]:
    """Growing modes to third order by RK4 in ln a on the grid a, normalised to Dplus(1) = 1.

    State: ln-derivative pairs (D, dD/dlna) of the orders 1, 2, 3a, 3b, and D3c alone.
    """

    def terms(x: float) -> tuple[float, float]:
        at = math.exp(x)
        e2 = expansion(c, np.float64(at), np) ** 2
        om, de = c.Omega_m * at**-3 / e2, omega_de(c, np.float64(at), np) / e2
        return 1.5 * om, 1 - 0.5 * (om + (1 + 3 * w(c, at)) * de)

    def slope(x: float, s: np.ndarray) -> np.ndarray:
        source, drag = terms(x)
        d1, v1, d2, v2, da, va, db, vb, _ = s
        force = lambda d, v, extra: source * (d + extra) - drag * v
        return np.array([v1, force(d1, v1, 0), v2, force(d2, v2, -(d1**2)), va, force(da, va, 2 * d1**3), vb, force(db, vb, 2 * d1 * d2 - 2 * d1**3), d2 * v1 - d1 * v2])

    x = np.log(a)
    a0 = a[0]
    # matter-dominated start; the sign of D3c is that of D2 dD1 - D1 dD2
    s = np.array([a0, a0, -3 / 7 * a0**2, -6 / 7 * a0**2, a0**3 / 3, a0**3, -10 / 21 * a0**3, -10 / 7 * a0**3, a0**3 / 7])
    rows = [s]
    for low, high in zip(x[:-1], x[1:]):
        parts = max(1, math.ceil((high - low) / 0.01))
        step = (high - low) / parts
        for n in range(parts):
            at = low + n * step
            k1 = slope(at, s)
            k2 = slope(at + step / 2, s + step / 2 * k1)
            k3 = slope(at + step / 2, s + step / 2 * k2)
            k4 = slope(at + step, s + step * k3)
            s = s + step / 6 * (k1 + 2 * k2 + 2 * k3 + k4)
        rows.append(s)
    d = np.array(rows)
    one = float(np.interp(0.0, x, d[:, 0])) if x[-1] >= -1e-12 else 1.0
    out = {"Dplus": d[:, 0] / one, "Dplusda": d[:, 1] / a / one}
    source = np.array([terms(v) for v in x])
    curve = source[:, 0] * d[:, 0] - source[:, 1] * d[:, 1]
    out["Dplusdada"] = (curve - d[:, 1]) / a**2 / one
    for n, (name, order) in enumerate((("D2plus", 2), ("D3plusa", 3), ("D3plusb", 3))):
        out[name], out[name + "da"] = d[:, 2 * n + 2] / one**order, d[:, 2 * n + 3] / a / one**order
    out["D3plusc"], out["D3pluscda"] = d[:, 8] / one**3, (d[:, 2] * d[:, 1] - d[:, 0] * d[:, 3]) / a / one**3
    return out


def conformal(c: Cosmology, a: np.ndarray) -> np.ndarray:
    """Superconformal time, the integral of da / (a^3 E) back from a = 1 where it is 0; Gauss-Legendre between the grid's points."""
    nodes, weights = np.polynomial.legendre.leggauss(8)
    ends = np.append(a, 1.0) if a[-1] < 1 else a
    mid, half = (ends[1:] + ends[:-1]) / 2, (ends[1:] - ends[:-1]) / 2
    at = mid[:, None] + half[:, None] * nodes
    piece = (weights / (at**3 * expansion(c, at, np))).sum(1) * half
    back = np.append(-np.cumsum(piece[::-1])[::-1], 0.0)
    return (back - np.interp(1.0, ends, back))[: len(a)]


def a_grid(a_min: float = 1e-3, a_max: float = 1.0, steps: int = 256, spacing: str = "log", power: float = 1.0) -> np.ndarray:
    """The time table's scale factors, log or power spaced; it must end at 1 or later for the normalisation."""
    if not 0 < a_min < a_max or steps < 2:
        raise ValueError("0 < a_min < a_max and two steps at least")
    return np.geomspace(a_min, a_max, steps) if spacing == "log" else np.linspace(a_min ** (1 / power), a_max ** (1 / power), steps) ** power


@dataclass(frozen=True)
class Times:
    """The time table on the driver: some hundred rows, monotone in a."""

    cosmology: Cosmology
    columns: dict[str, np.ndarray]

    @staticmethod
    def of(c: Cosmology, a: np.ndarray | None = None) -> Times:
        a = a_grid() if a is None else a
        return Times(c, {"a": a, "superconft": conformal(c, a), **growth(c, a)})

    def get(self, to: str, x, key: str = "a"):
        """Linear interpolation from one column to another, clamped at the ends."""
        return np.interp(x, self.columns[key], self.columns[to])

    def column(self, to: str, x: Column | str, key: str = "a") -> Column:
        """get for a column: from a, superconft or Dplus to any of the table's; null stays null."""
        at, values = self.columns[key], self.columns[to]

        @F.pandas_udf("double")
        def found(v: pd.Series) -> pd.Series:
            v = v.to_numpy(dtype=float, na_value=np.nan)
            return pd.Series(np.interp(v, at, values)).where(~np.isnan(v), None)

        return found(column(x).cast("double"))

    def growth_rate_column(self, a: Column | str) -> Column:
        """d ln D / d ln a."""
        a = column(a)
        return a * self.column("Dplusda", a) / self.column("Dplus", a)

    def fplus_column(self, a: Column | str) -> Column:
        """a^3 E dD/da."""
        a = column(a)
        return F.pow(a, 3) * expansion(self.cosmology, a) * self.column("Dplusda", a)

    def growth_rate(self, a):
        return a * self.get("Dplusda", a) / self.get("Dplus", a)

    def fplus(self, a):
        return a**3 * expansion(self.cosmology, np.float64(a), np) * self.get("Dplusda", a)

    def fplusda(self, a):
        """d(a^3 E D')/da = 1.5 Omega_m D / (a^2 E), the growth equation."""
        return 1.5 * self.cosmology.Omega_m * self.get("Dplus", a) / (a**2 * expansion(self.cosmology, np.float64(a), np))

    def frame(self, spark: SparkSession) -> DataFrame:
        names = list(self.columns)
        rows = [(n, *map(float, r)) for n, r in enumerate(zip(*self.columns.values()))]
        return spark.createDataFrame(rows, "i int, " + ", ".join(f"{x} double" for x in names))

    def updated(self, **columns) -> Times:
        return replace(self, columns={**self.columns, **columns})


def superconformal_frame(c: Cosmology, table: DataFrame) -> DataFrame:
    """i, a, superconft by the trapezoid rule over a table i, a that ends at a = 1."""
    f = table.withColumn("__f", 1 / (expansion(c, F.col("a")) * F.col("a") ** 3))
    ahead = Window.orderBy("i")
    step = f.withColumn("__s", (F.lead("a").over(ahead) - F.col("a")) * (F.lead("__f").over(ahead) + F.col("__f")) / 2)
    after = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    return step.withColumn("superconft", -F.coalesce(F.sum("__s").over(after), F.lit(0.0))).drop("__f", "__s")


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
