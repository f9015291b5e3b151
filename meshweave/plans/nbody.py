"""N-body integration: particle-mesh forces and drift-kick-drift steps over DataFrames.

The state is one row a particle: id, displacement sx, sy, sz and momentum vx, vy, vz. A step is two projections and
one join with the force; each step is checkpointed, so the plan stays short and a lost executor costs one step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cosmology import Times, expansion
from ..operators.fourier import assignment_kernel, gradient_kernel, inverse_laplacian_kernel, real_backward, real_forward, without_mean
from ..operators.mesh import AXES, Mesh, positions_from_displacement, wave_square
from ..operators.particles import exact_force_1d, gather, overdensity


def step_times(times: Times, a0: float, a1: float, steps: int | list[float], variable: str = "D") -> np.ndarray:
    """Scale factors of the step ends, evenly spaced in a, log_a, D or superconft, or as given."""
    if not isinstance(steps, int):
        return np.array(steps, dtype=float)
    if variable == "a":
        return np.linspace(a0, a1, steps + 1)
    if variable == "log_a":
        return np.geomspace(a0, a1, steps + 1)
    key = {"D": "Dplus", "superconft": "superconft"}[variable]
    if a0 == 0 and variable != "D":
        raise ValueError("steps from a = 0 are spaced in a or D")
    out = times.get("a", np.linspace(times.get(key, a0) if a0 > 0 else 0.0, times.get(key, a1), steps + 1), key)
    out[0], out[-1] = a0, a1
    return out


@dataclass(frozen=True)
class Step:
    """x += drift1 v; v = alpha v + beta A(x); x += drift2 v."""

    alpha: float
    beta: float
    drift1: float
    drift2: float


def coefficients(times: Times, a: np.ndarray, stepper: str = "bullfrog") -> list[Step]:
    """One Step for each interval; bullfrog may begin at a = 0, at the lattice with the first order as momentum. bullfrog and fastpm integrate in D with momenta dx/dD, symplectic in superconformal time."""
    c, out = times.cosmology, []
    if stepper == "symplectic":
        nodes, weights = np.polynomial.legendre.leggauss(5)
        for lo, hi in zip(a[:-1], a[1:]):
            mid = float(times.get("a", (times.get("superconft", lo) + times.get("superconft", hi)) / 2, "superconft"))
            at = (lo + hi) / 2 + (hi - lo) / 2 * nodes
            kick = 1.5 * c.Omega_m * float((weights / (at**2 * expansion(c, at, np))).sum() * (hi - lo) / 2)
            t = [float(times.get("superconft", x)) for x in (lo, mid, hi)]
            out.append(Step(1.0, kick, t[1] - t[0], t[2] - t[1]))
        return out
    for lo, hi in zip(a[:-1], a[1:]):
        if lo == 0 and stepper != "bullfrog":
            raise ValueError("only bullfrog begins at a = 0")
        d0, d1 = float(times.get("Dplus", lo)) if lo > 0 else 0.0, float(times.get("Dplus", hi))
        mid, half = (d0 + d1) / 2, (d1 - d0) / 2
        if stepper == "fastpm":
            alpha = float(times.fplus(lo) / times.fplus(hi))
        elif stepper == "bullfrog":
            # second order along the growing modes: the kick meets the second-order growth at the half step
            slope = [float(times.get("D2plusda", x) / times.get("Dplusda", x)) if x > 0 else 0.0 for x in (lo, hi)]
            b = ((float(times.get("D2plus", lo)) if lo > 0 else 0.0) + slope[0] * half) / mid - mid
            alpha = (slope[1] - b) / (slope[0] - b)
        else:
            raise ValueError("bullfrog, fastpm or symplectic")
        out.append(Step(alpha, (1 - alpha) / mid, half, half))
    return out


def force_field(particles: DataFrame, mesh: Mesh, order: int = 2, deconvolve: bool = False, gradient_order: int = 0, laplace_order: int = 0, alpha: float | None = None, count: int | None = None) -> DataFrame:
    """ax, ay, az = -grad inverse-Laplacian delta on every cell; all axes leave Fourier space in one pass.

    alpha: only the long-range part of a Gaussian split. deconvolve: both the deposit's and the gather's windows.
    """
    delta = overdensity(particles, mesh, order, count)
    f = without_mean(real_forward(delta, mesh, method="slab"), mesh)
    kernel = -inverse_laplacian_kernel(mesh, laplace_order)
    if deconvolve:
        kernel = kernel * assignment_kernel(mesh, order, twice=True)
    if alpha is not None:
        kernel = kernel * F.exp(wave_square(mesh) * (-0.5 * alpha**2))
    f = f.withColumn("__g", kernel)
    cols, pairs = [], []
    for d in range(mesh.dim):
        k = gradient_kernel(mesh, d, gradient_order) * F.col("__g")
        cols += [(-F.col("im") * k).alias(f"a{AXES[d]}"), (F.col("re") * k).alias(f"__{d}")]
        pairs.append((f"a{AXES[d]}", f"__{d}"))
    return real_backward(f.select(*mesh.modes, *cols), mesh, tuple(pairs), None, "slab").select(*mesh.cells, *[p[0] for p in pairs])


def pm_force(particles: DataFrame, mesh: Mesh, order: int = 2, **options) -> DataFrame:
    """id and ax, ay, az: the field of forces at the particles."""
    return gather(force_field(particles, mesh, order, **options), particles, mesh, order, tuple(f"a{x}" for x in mesh.places))


def interlaced_force(particles: DataFrame, mesh: Mesh, shifts: int = 2, **options) -> DataFrame:
    """Mean of forces on grids moved along the diagonal by fractions of a cell: aliases cancel."""
    total = None
    for n in range(shifts):
        step = mesh.box / mesh.n * n / shifts
        part = pm_force(particles.withColumns({x: F.col(x) + step for x in mesh.places}), mesh, **options)
        total = part if total is None else total.unionByName(part)
    return total.groupBy("id").agg(*[F.avg(f"a{x}").alias(f"a{x}") for x in AXES[: mesh.dim]])


def force(particles: DataFrame, mesh: Mesh, method: str = "pm", **options) -> DataFrame:
    """pm, exact (one dimension), nufft, or treepm: the long-range mesh part plus short-range pairs or tree walk, or with part="long" or "short" one of them."""
    if method == "exact":
        if mesh.dim != 1:
            raise ValueError("exact forces are one-dimensional")
        return exact_force_1d(particles, mesh.box).withColumnRenamed("a", "ax")
    if method == "pm":
        shifts = options.pop("antialias", 0)
        return interlaced_force(particles, mesh, shifts, **options) if shifts > 1 else pm_force(particles, mesh, **options)
    if method == "nufft":
        from ..operators.nufft import nufft_force

        return nufft_force(particles, mesh, **options)
    if method == "treepm":
        from ..operators.tree import short_range_force, tree_force

        alpha = options.get("alpha") or 1.25 * mesh.box / mesh.n
        theta, part = options.get("theta"), options.get("part", "both")
        if part not in ("both", "long", "short"):
            raise ValueError("both, long or short")
        if part == "long":
            return pm_force(particles, mesh, alpha=alpha, deconvolve=True)
        near = tree_force(particles, mesh, alpha, theta) if theta else short_range_force(particles, mesh, alpha)
        if part == "short":
            return near
        far = pm_force(particles, mesh, alpha=alpha, deconvolve=True)
        return far.unionByName(near).groupBy("id").agg(*[F.sum(f"a{x}").alias(f"a{x}") for x in AXES[: mesh.dim]])
    raise ValueError(method)


def drift(state: DataFrame, mesh: Mesh, by: float) -> DataFrame:
    return state.withColumns({f"s{x}": F.col(f"s{x}") + F.col(f"v{x}") * by for x in AXES[: mesh.dim]})


def kick(state: DataFrame, acceleration: DataFrame, mesh: Mesh, step: Step) -> DataFrame:
    axes = AXES[: mesh.dim]
    return state.join(acceleration, "id").select("id", *[f"s{x}" for x in axes], *[(F.col(f"v{x}") * step.alpha + F.col(f"a{x}") * step.beta).alias(f"v{x}") for x in axes])


def one_step(state: DataFrame, mesh: Mesh, grid: Mesh, step: Step, method: str = "pm", **options) -> DataFrame:
    """Drift, kick, drift. mesh is the particles' lattice and grid the force's mesh."""
    moved = drift(state, mesh, step.drift1)
    at = positions_from_displacement(moved, mesh)
    return drift(kick(moved, force(at, grid, method, **options), mesh, step), mesh, step.drift2)


def run(state: DataFrame, mesh: Mesh, times: Times, a: np.ndarray, stepper: str = "bullfrog", method: str = "pm", grid: Mesh | None = None, every: bool = False, **options) -> DataFrame:
    """The state after the last step, or after every one with columns step and a. Momenta are dx/dD, or P for symplectic."""
    grid, all_steps = grid or mesh, []
    for n, step in enumerate(coefficients(times, a, stepper)):
        state = one_step(state, mesh, grid, step, method, **options).checkpoint()
        if every:
            all_steps.append(state.select(F.lit(n + 1).alias("step"), F.lit(float(a[n + 1])).alias("a"), "*"))
    if not every:
        return state
    out = all_steps[0]
    for s in all_steps[1:]:
        out = out.unionByName(s)
    return out


def momentum(state: DataFrame, mesh: Mesh, times: Times, a: float, to: str = "P") -> DataFrame:
    """dx/dD to P = a^2 dx/dt (times F+), or back with to="D"."""
    f = float(times.fplus(a))
    return state.withColumns({f"v{x}": F.col(f"v{x}") * (f if to == "P" else 1 / f) for x in AXES[: mesh.dim]})


def tangent_step(state: DataFrame, mesh: Mesh, step: Step, box_force=None, grid: Mesh | None = None, **options) -> DataFrame:
    """Forward derivative through one step: of the particle-mesh force, or of one given with its tangent (box_force maps id, x.., tx.. to id, a.., ta..)."""
    from .gradients import force_tangent

    box_force = box_force or (lambda at: force_tangent(at, grid or mesh, **options))
    axes = AXES[: mesh.dim]
    moved = state.withColumns({**{f"s{x}": F.col(f"s{x}") + F.col(f"v{x}") * step.drift1 for x in axes}, **{f"ts{x}": F.col(f"ts{x}") + F.col(f"tv{x}") * step.drift1 for x in axes}})
    at = positions_from_displacement(moved, mesh).join(moved.select("id", *[F.col(f"ts{x}").alias(f"t{x}") for x in axes]), "id")
    met = moved.join(box_force(at), "id")
    out = met.select("id", *[f"s{x}" for x in axes], *[f"ts{x}" for x in axes], *[(F.col(f"v{x}") * step.alpha + F.col(f"a{x}") * step.beta).alias(f"v{x}") for x in axes], *[(F.col(f"tv{x}") * step.alpha + F.col(f"ta{x}") * step.beta).alias(f"tv{x}") for x in axes])
    return out.withColumns({**{f"s{x}": F.col(f"s{x}") + F.col(f"v{x}") * step.drift2 for x in axes}, **{f"ts{x}": F.col(f"ts{x}") + F.col(f"tv{x}") * step.drift2 for x in axes}})


def inverse_step(state: DataFrame, mesh: Mesh, grid: Mesh, step: Step, method: str = "pm", **options) -> DataFrame:
    """The state before a step: the reverse pass of the adjoint runs on it without stored states."""
    back = drift(state, mesh, -step.drift2)
    a = force(positions_from_displacement(back, mesh), grid, method, **options)
    axes = AXES[: mesh.dim]
    un = back.join(a, "id").select("id", *[f"s{x}" for x in axes], *[((F.col(f"v{x}") - F.col(f"a{x}") * step.beta) / step.alpha).alias(f"v{x}") for x in axes])
    return drift(un, mesh, -step.drift1)


