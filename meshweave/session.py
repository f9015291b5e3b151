"""One immutable object that carries a mesh, a cosmology and what was derived so far; every step gives a new one."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cosmology as C
from .operators import fourier, mesh as M, particles as P, statistics
from .plans import initial, lpt, nbody, ppt, sheet
from .sources import files


@dataclass(frozen=True)
class Universe:
    """A periodic box of dim dimensions with n^dim particles on a lattice."""

    spark: SparkSession
    mesh: M.Mesh
    cosmology: C.Cosmology = C.PLANCK15
    times: C.Times | None = None
    pk: DataFrame | None = None
    potential: DataFrame | None = None
    orders: DataFrame | None = None
    order: int = 0
    exact: bool = False

    def with_times(self, **grid) -> Universe:
        return replace(self, times=C.Times.of(self.cosmology, C.a_grid(**grid)))

    def with_spectrum(self, transfer: str = "Eisenstein-Hu", path: str | None = None, modes: int = 1000, cut: str | None = None, k0: float = 1.0) -> Universe:
        """P(k) from a transfer function, or of any other origin from a text file."""
        if path is not None:
            return replace(self, pk=C.normalised(files.read_spectrum(self.spark, path), self.cosmology.sigma8))
        return replace(self, pk=C.linear_spectrum(self.spark, self.cosmology, self.mesh.box, self.mesh.n, self.mesh.dim, transfer, modes, cut, k0))

    def spectrum_at(self, a: float) -> DataFrame:
        return self.pk.withColumn("pk", F.col("pk") * float(self.times.get("Dplus", a)) ** 2)

    def with_initial(self, seed: int = 0, space: str = "real", noise: DataFrame | None = None, order: str | None = "stable", sphere: bool = False, deviation: float | None = None, places: DataFrame | None = None) -> Universe:
        """A Gaussian potential; with places (id, x, y, z, one a cell) its values there, by a non-uniform transform."""
        phi = initial.gaussian_potential(self.spark, self.mesh, self.pk, seed, space, noise, order, sphere)
        if places is not None:
            phi = initial.evaluated_at(phi, self.mesh, places)
        if deviation is not None:
            field = fourier.backward(fourier.scaled(phi, -M.wave_square(self.mesh)), self.mesh)
            spread = field.agg(F.stddev_pop("v").alias("__s"))
            phi = phi.join(F.broadcast(spread), how="cross").select(*self.mesh.modes, *[(F.col(c) * deviation / F.col("__s")).alias(c) for c in ("re", "im")])
        return replace(self, potential=phi)

    def with_external(self, delta: DataFrame | None = None, phi: DataFrame | None = None, positions: DataFrame | None = None) -> Universe:
        """Initial conditions from one of: a density mesh, a potential mesh, or particles (their displacement is the first order)."""
        if sum(x is not None for x in (delta, phi, positions)) != 1:
            raise ValueError("give one of delta, phi and positions")
        if positions is not None:
            at = files.unwrapped(initial.validated(positions, self.mesh, ("id", *self.mesh.places)), self.mesh)
            cells = M.index_columns(F.col("id"), self.mesh, self.mesh.cells)
            return replace(self, orders=at.select("id", *[(F.col(x) - c * (self.mesh.box / self.mesh.n)).alias(f"s1{x}") for x, c in zip(self.mesh.places, cells)]), order=1)
        if phi is None:
            phi = fourier.potential(initial.validated(delta, self.mesh, (*self.mesh.cells, "v")), self.mesh)
        return replace(self, potential=fourier.forward(initial.validated(phi, self.mesh, (*self.mesh.cells, "v")), self.mesh))

    def with_lpt(self, order: int = 1, transverse: bool = True, exact: bool = False) -> Universe:
        """exact: every part of the orders, to the third, grows by the cosmology's own growth functions."""
        if exact and order > 3:
            raise ValueError("exact growth goes to third order")
        return replace(self, orders=lpt.displacements(self.potential, self.mesh, order, transverse, split=exact), order=order, exact=exact)

    def initial_density(self, a: float | None = None) -> DataFrame:
        """Density of the initial potential, grown linearly to a."""
        grow = 1.0 if a is None else float(self.times.get("Dplus", a))
        return fourier.backward(fourier.scaled(self.potential, -M.wave_square(self.mesh) * grow), self.mesh)

    def displacement(self, a: float, what: str = "psi") -> DataFrame:
        return lpt.evaluated(self.orders, self.mesh, self.times, a, self.order, what, self.exact)

    def positions(self, a: float) -> DataFrame:
        return M.positions_from_displacement(self.displacement(a), self.mesh)

    def nbody(self, a0: float, a1: float, steps: int | list[float] = 10, variable: str = "D", stepper: str = "bullfrog", method: str = "pm", grid: int | None = None, every: bool = False, start: DataFrame | None = None, **options) -> DataFrame:
        """id, displacement and momentum P = a^2 dx/dt after the last step (or all), from the LPT state at a0 (0 for bullfrog), or from start: id, places x and momenta px as P."""
        places = self.mesh.places
        if start is not None:
            cells = M.index_columns(F.col("id"), self.mesh, self.mesh.cells)
            at = initial.validated(start, self.mesh, ("id", *places, *[f"p{x}" for x in places]))
            state = at.select("id", *[M.nearest_image(F.col(x) - c * (self.mesh.box / self.mesh.n), self.mesh.box).alias(f"s{x}") for x, c in zip(places, cells)], *[F.col(f"p{x}").alias(f"v{x}") for x in places])
            if stepper != "symplectic":
                state = nbody.momentum(state, self.mesh, self.times, a0, to="D")
        else:
            pi = self.displacement(a0, "D")
            state = self.displacement(a0).join(pi.select("id", *[F.col(f"s{x}").alias(f"v{x}") for x in places]), "id")
            if stepper == "symplectic":
                state = nbody.momentum(state, self.mesh, self.times, a0)
        a = nbody.step_times(self.times, a0, a1, steps, variable)
        out = nbody.run(state, self.mesh, self.times, np.asarray(a), stepper, method, self.mesh.at(grid) if grid else None, every, **options)
        return out if stepper == "symplectic" or every else nbody.momentum(out, self.mesh, self.times, a1)

    def acceleration(self, at: DataFrame, n: int | None = None, method: str = "pm", on_mesh: bool = False, **options) -> DataFrame:
        """The force on particles at id, x ..., or with on_mesh the mesh method's field; part="long" or "short" picks one side of treepm."""
        grid = self.mesh.at(n or self.mesh.n)
        if on_mesh and method != "pm":
            raise ValueError("only the mesh method has a field")
        return nbody.force_field(at, grid, **options) if on_mesh else nbody.force(at, grid, method, **options)

    def propagator(self, a: float, **options) -> tuple[DataFrame, float]:
        phi = fourier.backward(self.potential, self.mesh)
        return ppt.propagate(phi, self.mesh, float(self.times.get("Dplus", a)), **options)

    def density(self, at: DataFrame, n: int | None = None, order: int = 2, deconvolve: bool = False, interlace: bool = False) -> DataFrame:
        grid = self.mesh.at(n or self.mesh.n)
        out = fourier.interlaced(at, grid, order) if interlace else P.overdensity(at, grid, order)
        return fourier.deconvolved(out, grid, order) if deconvolve else out

    def resampled(self, a: float, resample: int, how: str = "fourier") -> DataFrame:
        return sheet.spawned(self.displacement(a), self.mesh, resample, how)

    def power(self, field: DataFrame, bins: int | tuple[float, ...] = 8, n: int | None = None, **options) -> DataFrame:
        return statistics.power_spectrum(field, self.mesh.at(n or self.mesh.n), bins, **options)

    def cross(self, a: DataFrame, b: DataFrame, bins: int = 8) -> DataFrame:
        return statistics.cross_spectrum(a, b, self.mesh, bins)

    def bispectrum(self, field: DataFrame, bins: int = 3, equilateral: bool = False) -> DataFrame:
        return statistics.bispectrum(field, self.mesh, bins, equilateral)

    def jacobian(self, a: float, **options) -> DataFrame:
        psi = self.displacement(a).join(M.grid(self.spark, self.mesh), "id")
        return statistics.jacobian(psi, self.mesh, **options)

    def save(self, state: DataFrame, a: float, path: str, form: str = "gadget123") -> None:
        """A snapshot in a format's units: state has id, x and p columns."""
        c, m = self.cosmology, self.mesh
        header = files.Header(a, m.box, m.size, c.Omega_m, c.Omega_de, c.h, files.particle_mass(c, m.box, m.size))
        files.write_snapshot(files.to_units(state, m, a, c.h, form), header, path)
