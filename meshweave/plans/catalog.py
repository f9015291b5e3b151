"""The registered queries: operators applied to fixtures made from the driver's tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cosmology as C
from ..functions import usercode
from ..operators import fourier as X
from ..operators import mesh as M
from ..operators import asof, nufft, particles, statistics, tree
from ..sources import curve, files, fixtures, gadget, ranlux
from . import gradients, initial, lpt, nbody, oracle, ppt, sheet

Query = Callable[[SparkSession, str], DataFrame]
MESH, BOX, N = fixtures.MESH, fixtures.BOX, 8
LINE = M.Mesh(1, 64, 1.0)
FLAT = M.Mesh(2, N, BOX)
PLANCK = C.PLANCK15


def q(x: Column | str, digits: int = 6) -> Column:
    """Rounded, with one zero, so that two engines' last bits compare."""
    return F.round(C.column(x), digits) + F.lit(0.0)


def field(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*MESH.cells, q("v", digits).alias("v"))


def modes(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*MESH.modes, q("re", digits).alias("re"), q("im", digits).alias("im"))


def modes2(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*FLAT.modes, q("re", digits).alias("re"), q("im", digits).alias("im"))


def field_spectrum(spark: SparkSession, d: str) -> DataFrame:
    return X.forward(fixtures.field(spark, d), MESH)


def wrap_positions(spark, d):
    return fixtures.moving(spark, d).select("id", q(M.wrap(F.col("x") * 3 - 150, BOX)).alias("x"))


def min_image(spark, d):
    return fixtures.particles(spark, d).select("id", q(M.nearest_image(F.col("x") - F.col("y"), BOX)).alias("d"))


def pair_distance(spark, d):
    p = fixtures.particles(spark, d)
    a = p.select("id", *[F.col(x).alias(f"a{x}") for x in "xyz"])
    b = p.select((F.col("id") - 1).alias("id"), *[F.col(x).alias(f"b{x}") for x in "xyz"])
    return a.join(b, "id").select("id", q(M.distance([F.col(f"a{x}") for x in "xyz"], [F.col(f"b{x}") for x in "xyz"], BOX)).alias("r"))


def lagrangian_grid(spark, d):
    """The lattice, with how many events fall to each place by their number."""
    found = spark.read.parquet(f"{d}/events.parquet").groupBy(F.pmod("event_id", F.lit(MESH.size)).alias("id")).agg(F.count("*").alias("n"))
    return M.lagrangian_grid(spark, MESH).join(found, "id")


def fourier_grid(spark, d):
    g = M.fourier_grid(spark, MESH).join(X.real_forward(fixtures.field(spark, d), MESH), MESH.modes)
    return g.select(*MESH.modes, *[q(c, 9).alias(c) for c in ("kx", "ky", "kz", "k")], q(F.col("re") * F.col("re") + F.col("im") * F.col("im"), 4).alias("power"))


def slice_filter(spark, d):
    return M.near_slice(fixtures.particles(spark, d), MESH, (0,), 20.0).select("id")


def subsample_stride(spark, d):
    mesh = M.Mesh(3, 16, BOX)
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.pmod("event_id", F.lit(mesh.size)).alias("id"), F.col("event_id").alias("was"))
    return M.stride(rows, mesh, 4)


def glass_detile(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), M.detile(F.pmod("event_id", F.lit(4096)), 2, 8).alias("place"))


def deposit(order: int) -> Query:
    def run(spark, d):
        p = fixtures.particles(spark, d)
        return field(particles.overdensity(p, MESH, order))

    return run


def deposit_weighted(spark, d):
    return field(particles.deposit(fixtures.particles(spark, d), MESH, 2, {"v": F.col("v")}), 5)


def gather(order: int) -> Query:
    def run(spark, d):
        return particles.gather(fixtures.field(spark, d), fixtures.particles(spark, d), MESH, order).select("id", q("v").alias("v"))

    return run


def redshift_shift(spark, d):
    return particles.redshift_shift(fixtures.moving(spark, d), MESH, 12.5).select("id", q("z").alias("z"))


def cell_velocity(spark, d):
    return field(particles.mean_on_mesh(fixtures.moving(spark, d), MESH, F.col("pz")))


def dft_forward(spark, d):
    return modes(field_spectrum(spark, d))


def dft_inverse(spark, d):
    return field(X.backward(field_spectrum(spark, d), MESH))


def grad_kernel(order: int) -> Query:
    return lambda spark, d: field_spectrum(spark, d).select(*MESH.modes, q(F.col("re") * X.gradient_kernel(MESH, 1, order)).alias("g"))


def inv_laplace(order: int) -> Query:
    return lambda spark, d: field_spectrum(spark, d).select(*MESH.modes, q(F.col("im") * X.inverse_laplacian_kernel(MESH, order), 4).alias("g"))


def mak_kernel(spark, d):
    return field_spectrum(spark, d).select(*MESH.modes, q(F.col("re") * X.assignment_kernel(MESH, 2)).alias("cic"), q(F.col("re") * X.assignment_kernel(MESH, 3, twice=True), 4).alias("tsc_twice"))


def deconvolve(spark, d):
    return field(X.deconvolved(fixtures.field(spark, d), MESH))


def poisson(spark, d):
    return field(X.potential(fixtures.field(spark, d), MESH), 4)


def gaussian_split(spark, d):
    return field(X.backward(X.long_range(field_spectrum(spark, d), MESH, 10.0), MESH))


def fourier_crop(spark, d):
    return modes(M.crop(field_spectrum(spark, d), MESH.at(4), MESH))


def fourier_pad(spark, d):
    return modes(M.pad(field_spectrum(spark, d), MESH, MESH.at(12)))


def dealiased_product(spark, d):
    w = field_spectrum(spark, d)
    return modes(X.dealiased_product(w, w, MESH))


def hermitian_sym(spark, d):
    g = X.real_forward(fixtures.field(spark, d), MESH).select(*MESH.modes, (F.col("re") + 0.1 * F.col("jx")).alias("re"), (F.col("im") - 0.05 * F.col("jy")).alias("im"))
    return modes(X.hermitian(g, MESH))


def k_order(kind: str) -> Query:
    def run(spark, d):
        g = X.real_forward(fixtures.field(spark, d), MESH)
        return X.mode_order(g, MESH, kind).select(*MESH.modes, "rank", q("re").alias("re"))

    return run


def fourier_shift(spark, d):
    return field(X.shifted(fixtures.field(spark, d), MESH, (3.0, 0.0, 5.0)))


def power_spectrum(spark, d):
    delta = particles.overdensity(fixtures.particles(spark, d), MESH)
    out = statistics.power_spectrum(delta, MESH, 6)
    return out.select("bin", "modes", q("k").alias("k"), q("pk", 4).alias("pk"))


def cross_spectrum(spark, d):
    w = fixtures.field(spark, d)
    other = w.withColumn("v", F.col("v") * F.col("v") + 0.1 * F.col("ix"))
    out = statistics.cross_spectrum(w, other, MESH, 6)
    return out.select("bin", q("k").alias("k"), q("p1", 3).alias("p1"), q("p2", 3).alias("p2"))


def bispectrum(spark, d):
    delta = particles.overdensity(fixtures.particles(spark, d), MESH)
    out = statistics.bispectrum(delta, MESH, 2)
    return out.select("b1", "b2", "b3", "triangles", q("b", 0).alias("b"))


def bispectrum_direct(spark, d):
    nbody_dir(spark)
    delta = particles.overdensity(fixtures.particles(spark, d), MESH)
    out = statistics.bispectrum(delta, MESH, 2, direct=True)
    return out.select("b1", "b2", "b3", "triangles", q("b", 0).alias("b"))


def jacobian_det(spark, d):
    psi = fixtures.field(spark, d).select(*MESH.cells, (2 * F.col("v")).alias("sx"), F.col("v").alias("sy"), (0.5 * F.col("v")).alias("sz"))
    return statistics.jacobian(psi, MESH).select(*MESH.cells, q("det").alias("det"))


def e_of_a(spark, d):
    a = F.col("a")
    return fixtures.scale_factors(spark, d).select("id", q(C.expansion(PLANCK, a), 5).alias("e"), q(C.hubble(PLANCK, a), 3).alias("h"), q(C.expansion_slope(PLANCK, a), 3).alias("slope"), q(C.omega_de(PLANCK, a)).alias("de"))


def transfer(kind: str) -> Query:
    return lambda spark, d: fixtures.wave_numbers(spark, d).select("id", q(C.TRANSFER[kind](PLANCK, F.col("k")), 7).alias("t"))


def sigma8(spark, d):
    return C.sigma_squared(fixtures.spectrum_table(spark, d)).select(q("sigma2", 9).alias("sigma2"))


def linear_ps(spark, d):
    """The linear spectrum at every event's wave number."""
    table = C.linear_spectrum(spark, PLANCK, BOX, N, modes=64)
    return asof.interpolate(table, fixtures.wave_numbers(spark, d), "k", "pk", at="k", into="pk").select("id", q("pk", 3).alias("pk"))


def superconft_table(spark, d):
    return C.superconformal_frame(PLANCK, fixtures.time_table(spark, d)).select("i", q("superconft", 5).alias("superconft"))


def interp_table(spark, d):
    x = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), (0.001 + F.col("value") / 100).alias("x"))
    return asof.interpolate(fixtures.spectrum_table(spark, d), x, "k", "pk").select("id", q("y", 8).alias("y"))


def interp_asof(spark, d):
    """Knots from all orders, of equal prices the least key; probes from all events, some beyond the ends: the way of large tables."""
    nbody_dir(spark)
    orders = spark.read.parquet(f"{d}/orders.parquet")
    probes = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), (F.col("value") * 4000 - 20000).alias("x"))
    return asof.interpolate(orders, probes, "o_totalprice", "o_orderkey", small=0, ranges=16).select("id", q("y", 4).alias("y"))


def time_maps(spark, d):
    """Scale factors to superconformal time, growth and back, as columns, for every event; the table has eight knots with closed forms."""
    import numpy as np

    a = np.arange(1, 9) / 8
    times = C.Times(C.EDS, {"a": a, "superconft": -2 * (a**-0.5 - 1), "Dplus": a**0.9, "Dplusda": 0.9 * a**-0.1})
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), (F.col("value") / 90).alias("a"))
    s = times.column("superconft", "a")
    return events.select("id", q(s, 7).alias("superconft"), q(times.column("a", s, "superconft"), 7).alias("back"), q(times.column("a", F.col("a"), "Dplus"), 7).alias("from_growth"), q(times.growth_rate_column("a"), 7).alias("rate"), q(times.fplus_column("a"), 6).alias("fplus"))


def eds() -> C.Times:
    return C.Times.of(C.EDS)


def plane_wave(spark, d):
    import numpy as np

    a = np.array([0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0])
    times = C.Times(C.EDS, {"a": a, "superconft": -2 * (a**-0.5 - 1), "Dplus": a, "Dplusda": np.ones(8)})
    w = initial.plane_wave(times, LINE, 0.25, a_cross=0.5)
    g = fixtures.line(spark, d).select("id", (F.col("x") / BOX).alias("qx"))
    return g.select("id", q(w["x"], 9).alias("x"), q(w["px"], 9).alias("px"), q(w["delta"], 9).alias("delta"))


def zeldovich_1d(spark, d):
    """The orders' overdensity on a line, weakened, as a potential."""
    at = fixtures.line(spark, d).select("id", (F.col("x") / BOX).alias("x"))
    phi = particles.overdensity(at, LINE).withColumn("v", F.col("v") * 1e-4)
    return lpt.displacements(X.forward(phi, LINE), LINE).select("id", q("s1x", 8).alias("sx"))


def exact_acc_1d(spark, d):
    return particles.exact_force_1d(fixtures.line(spark, d), BOX).select("id", q("a").alias("a"))


def dkd_step(spark, d):
    lattice = M.Mesh(1, N, BOX)
    state = fixtures.line(spark, d).select("id", F.col("x").alias("sx"), F.col("p").alias("vx"))
    out = nbody.one_step(state, lattice, lattice, nbody.Step(0.9, 0.05, 2.0, 2.0), "exact")
    return out.select("id", q("sx", 5).alias("sx"), q("vx").alias("vx"))


def morton_3d(spark, d):
    return tree.keyed(fixtures.particles(spark, d), MESH, 10).select("id", "morton")


def morton_2d(spark, d):
    return tree.keyed(fixtures.particles(spark, d), FLAT, 10).select("id", "morton")


def multipoles(spark, d):
    nodes = tree.multipoles(fixtures.particles(spark, d), MESH, 3)
    return nodes.groupBy("level").agg(F.count("*").alias("nodes"), q(F.sum("m")).alias("m"), q(F.sum("dx"), 3).alias("dx"), q(F.sum("qyz"), 1).alias("qyz"))


def short_range_pairs(spark, d):
    nbody_dir(spark)
    return tree.neighbour_pairs(fixtures.particles(spark, d), MESH, 2.0).select("a", "b", q("r").alias("r"))


def gadget_units(spark, d):
    out = files.to_units(fixtures.moving(spark, d), MESH, 0.25, 0.7)
    return out.select("id", q("x").alias("x"), q("vx").alias("vx"), q("vz").alias("vz"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that all executors share."""
    import uuid

    nbody_dir(spark)
    sc = spark.sparkContext
    return f"{(sc.getConf().get('spark.checkpoint.dir') or sc.getCheckpointDir()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


HEAD = files.Header(0.25, BOX, 0, 0.3, 0.7, 0.7, 1.5)


def gadget_snapshot(spark, d):
    """Particles in a format's units, written as a snapshot of several files and read back in two ranges of ids and some columns."""
    path = scratch(spark, "snapshot")
    gadget.write(files.to_units(fixtures.moving(spark, d), MESH, 0.25, 0.7), path, HEAD, rows=4096)
    columns, end = ["id", "x", "z", "vy", "mass"], (1 << 63) - 1
    both = gadget.read(spark, path, columns, rows=3000, ids=(-end, 3332)).unionByName(gadget.read(spark, path, columns, pushdown=True).where("id >= 3333"))
    return both.select("id", q("x").alias("x"), q("z").alias("z"), q("vy").alias("vy"), "mass")


def snapshot_series(spark, d):
    """Every second snapshot of a series of drifting particles, and one chosen by a filter."""
    path, moving = scratch(spark, "series"), fixtures.moving(spark, d)
    for snap in range(4):
        at = moving.withColumns({x: M.wrap(F.col(x) + F.col(f"p{x}") * (5.0 * snap), BOX) for x in "xyz"})
        gadget.write(files.to_units(at, MESH, 0.25, 0.7), path, HEAD, rows=8192, snap=snap)
    even = gadget.read(spark, path, ["snap", "id", "y"], every=2)
    one = gadget.read(spark, path, ["snap", "id", "y"], snaps=[3])
    return even.unionByName(one).select("snap", "id", q("y").alias("y"))


def box_queries(spark, d):
    """A slice, a skewer, a box over the edge and a small box, each read from particles stored along the curve."""
    path = scratch(spark, "curve")
    curve.write_sorted(fixtures.particles(spark, d), MESH, path)
    boxes = {"slice": [(25.0, 37.5), None, None], "skewer": [(50.0, 62.5), (0.0, 12.5), None], "edge": [(90.0, 105.0), (-10.0, 20.0), (30.0, 80.0)], "small": [(40.0, 43.0), (71.0, 75.0), (11.0, 19.0)]}
    parts = [curve.read_box(spark, path, MESH, box).select(F.lit(name).alias("box"), "id", *[q(x).alias(x) for x in "xyz"]) for name, box in boxes.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def positions_from_psi(spark, d):
    psi = fixtures.particles(spark, d).select(F.pmod("id", F.lit(MESH.size)).alias("id"), (F.col("x") / 10).alias("sx"), (F.col("y") - 50).alias("sy"), F.lit(-0.5).alias("sz"))
    return M.positions_from_displacement(psi, MESH).select("id", *[q(x).alias(x) for x in "xyz"])


def dilated_mask(spark, d):
    return M.dilated(fixtures.field(spark, d).select(*MESH.cells, (F.col("v") > 0.4).alias("v")), MESH)


def sphere_mode(spark, d):
    return modes(M.spherical(field_spectrum(spark, d), MESH))


def spectrum_cutoff(spark, d):
    pk = fixtures.spectrum_table(spark, d)
    return pk.select("i", *[q(F.col("pk") * C.cutoff(F.col("k"), kind, 0.1), 9).alias(kind) for kind in ("sharp", "gaussian")])


def field_rescaled(spark, d):
    return field(statistics.rescaled(fixtures.field(spark, d), 0.5))


def density_from_phi(spark, d):
    return field(X.density(fixtures.field(spark, d), MESH))


def field_derivative(spark, d):
    return field(X.derivative(fixtures.field(spark, d), MESH, 1, 4))


def shift_linear(spark, d):
    return field(X.shifted(fixtures.field(spark, d), MESH, (3.0, 0.0, 5.0), "linear"))


def value_at(spark, d):
    set_plane = M.with_value_at(fixtures.field(spark, d), "v", F.col("ix") == 3, 9.0)
    return field(M.with_value_at(set_plane, "v", F.col("iz") == 0, 0.5, add=True))


def grid_units(spark, d):
    return fixtures.particles(spark, d).select("id", q(M.to_cells(F.col("x"), MESH)).alias("cell"), q(M.to_box(F.col("y"), MESH)).alias("place"))


def snapshot_stride(spark, d):
    snaps = fixtures.particles(spark, d).select("id", (F.pmod("id", F.lit(11)) * 2).cast("int").alias("snap"))
    return M.every_snapshot(snaps, 3)


def spectrum_deviation(spark, d):
    delta = particles.overdensity(fixtures.particles(spark, d), MESH)
    return statistics.power_spectrum(delta, MESH, 6, deviation=True).select("bin", q("sd", 3).alias("sd"))


def spectrum_gradient(spark, d):
    """How a weighted sum of the spectrum's bins changes with every particle's position."""
    out = gradients.spectrum_gradient(fixtures.particles(spark, d), MESH, [1.0, -0.5, 0.25, 2.0, 0.0, 1.0], 6, order=3)
    return out.select("id", *[q(f"g{x}", 7).alias(f"g{x}") for x in "xyz"])


def force_tangent(spark, d):
    """The force's change along the particles' momenta."""
    moving = fixtures.moving(spark, d).withColumns({f"t{x}": F.col(f"p{x}") for x in "xyz"})
    return gradients.force_tangent(moving, MESH, 3).select("id", *[q(f"ta{x}", 5).alias(f"ta{x}") for x in "xyz"])


def user_code(spark, d):
    """Cells through a user's table function, plane by plane, and a user's scalar function, from SQL text."""
    import numpy as np

    usercode.scalar(spark, "squeezed", lambda v: np.sign(v) * np.log1p(np.abs(v)))
    usercode.table(spark, "plane_facts", lambda c: {"cells": [len(c["v"])], "top": [c["v"].max()], "spread": [c["v"].max() - c["v"].min()]}, "ix int, cells long, top double, spread double", keys=("ix",))
    particles.overdensity(fixtures.particles(spark, d), MESH).createOrReplaceTempView("meshweave_cells")
    return spark.sql("SELECT ix, cells, round(squeezed(top), 6) + 0.0D AS top, round(spread, 6) + 0.0D AS spread FROM plane_facts(TABLE(SELECT ix, v FROM meshweave_cells) PARTITION BY ix)")


def gather_gradient(spark, d):
    out = particles.gather(fixtures.field(spark, d), fixtures.particles(spark, d), MESH, 3, gradient=True)
    return out.select("id", *[q(f"dv_d{x}").alias(f"g{x}") for x in "xyz"])


def deposit_tangent(spark, d):
    p = fixtures.moving(spark, d).withColumns({f"t{x}": F.col(f"p{x}") for x in "xyz"})
    return particles.deposit_tangent(p, MESH, 3).select(*MESH.cells, q("dv", 5).alias("dv"))


# --- transforms in Arrow, iterative and random ----------------------------------------------------------------------------


def pencil_fft(spark, d):
    return modes(X.forward(fixtures.field(spark, d, M.Mesh(3, 16, BOX)), M.Mesh(3, 16, BOX), method="pencil"))


def skewer(spark, d):
    out = particles.on_slice(fixtures.particles(spark, d), MESH, (3, (2, 6)))
    return out.select("iy", "iz", q("v").alias("v"))


def interlaced(spark, d):
    return field(X.interlaced(fixtures.particles(spark, d), MESH))


def redshift_field(spark, d):
    return field(particles.cell_velocity_shift(fixtures.moving(spark, d), MESH, 12.5))


def nufft_type1(spark, d):
    p = fixtures.particles(spark, d).select("id", "x", "y", F.lit(1.0).alias("re"))
    return modes2(nufft.type1(p, FLAT, 1e-12), 3)


def nufft_type2(spark, d):
    f = M.fourier_grid(spark, FLAT, full=True).select(*FLAT.modes, F.sin(F.col("id") * 0.7).alias("re"), F.cos(F.col("id") * 1.3).alias("im"))
    out = nufft.type2(f, fixtures.particles(spark, d).select("id", "x", "y"), FLAT, 1e-12, gradient=True)
    return out.select("id", q("re", 4).alias("re"), q("im", 4).alias("im"), q("dre_dx", 4).alias("slope"))


def nufft_force_fine(spark, d):
    p = fixtures.particles(spark, d).select("id", "x", "y")
    return nufft.nufft_force(p, FLAT, 1e-12).select("id", q("ax", 3).alias("ax"), q("ay", 3).alias("ay"))


def nufft_force(spark, d):
    p = fixtures.particles(spark, d).select("id", "x", "y")
    return nufft.nufft_force(p, FLAT).select("id", q("ax", 3).alias("ax"), q("ay", 3).alias("ay"))


def pm_force(spark, d):
    return nbody.pm_force(fixtures.particles(spark, d), MESH, 3, deconvolve=True).select("id", *[q(c).alias(c) for c in ("ax", "ay", "az")])


def mesh_64(spark, d):
    """Forces on the cells of a mesh of 64 an axis: deposit by blocks, half spectra by planes and columns; sums over planes are compared."""
    cells = nbody.force_field(fixtures.particles(spark, d), MESH.at(64), 2)
    return cells.groupBy("ix").agg(F.count("*").alias("cells"), *[q(F.sum(F.col(f"a{x}") * F.col(f"a{x}")), 3).alias(f"a{x}") for x in "xyz"])


def tree_pm(spark, d):
    """Mesh and tree; at this alpha no node within reach is far enough to serve as one mass, so the walk is the pair sum."""
    nbody_dir(spark)
    p = fixtures.particles(spark, d)
    return nbody.force(p, MESH, "treepm", alpha=1.0, theta=0.5).select("id", *[q(c, 3).alias(c) for c in ("ax", "ay", "az")])


def short_range_force(spark, d):
    nbody_dir(spark)
    return tree.short_range_force(fixtures.particles(spark, d), MESH, 1.5).select("id", *[q(c, 3).alias(c) for c in ("ax", "ay", "az")])


def tree_walk(spark, d):
    """Whether the walk with an opening angle is within a thousandth of the typical force of the pair sum, along each axis."""
    nbody_dir(spark)
    p = fixtures.particles(spark, d)
    near = tree.tree_force(p, MESH, 4.0, 0.5)
    exact = tree.tree_force(p, MESH, 4.0, 0.0).select("id", *[F.col(f"a{x}").alias(f"e{x}") for x in "xyz"]).checkpoint()
    typical = exact.agg(F.sqrt(F.avg(sum((F.col(f"e{x}") * F.col(f"e{x}") for x in "yz"), F.col("ex") * F.col("ex")))).alias("typical"))
    return near.join(exact, "id").join(F.broadcast(typical), how="cross").select("id", *[(F.abs(F.col(f"a{x}") - F.col(f"e{x}")) < 1e-3 * F.col("typical")).alias(f"a{x}") for x in "xyz"])


def _potential(spark: SparkSession, d: str, mesh: M.Mesh) -> DataFrame:
    """A potential with the particles' overdensity, weakened, as its Laplacian."""
    delta = X.without_mean(X.forward(fixtures.field(spark, d, mesh), mesh), mesh)
    return X.scaled(delta, X.inverse_laplacian_kernel(mesh) * 0.05)


def gaussian_field(spark, d):
    """The particles' overdensity as the noise of a Gaussian potential."""
    pk = C.linear_spectrum(spark, PLANCK, MESH.box, MESH.n)
    return modes(initial.gaussian_potential(spark, MESH, pk, noise=fixtures.field(spark, d)))


def fourier_noise(spark, d):
    return modes(initial.fourier_noise(spark, MESH, 11))


def ngenic_noise(spark, d):
    return modes(ranlux.ngenic_noise(spark, MESH, 42))


def ngenic_modes(spark, d):
    """What makes the noise the spectrum of a real field without mean: counts of modes, of a mean, of Nyquist modes and of modes in the plane jz = 0 without a conjugate."""
    rows = ranlux.ngenic_noise(spark, MESH, 42)
    half, mirror = MESH.n // 2, [F.pmod(-F.col(j), F.lit(MESH.n)).cast("int").alias(j) for j in MESH.modes[:2]]
    plane = rows.where("jz = 0")
    paired = plane.join(plane.select(*mirror, F.col("re").alias("r"), F.col("im").alias("i")), ["jx", "jy"]).where("re = r AND im = -i")
    nyquist = F.col("jx").eqNullSafe(half) | F.col("jy").eqNullSafe(half) | F.col("jz").eqNullSafe(half)
    whole = rows.agg(F.count("*").alias("modes"), F.count_if((F.col("jx") == 0) & (F.col("jy") == 0) & (F.col("jz") == 0)).alias("mean"), F.count_if(nyquist).alias("nyquist"), F.count_if(F.col("jz") == 0).alias("plane"))
    return whole.crossJoin(paired.agg(F.count("*").alias("paired"))).select("modes", "mean", "nyquist", (F.col("plane") - F.col("paired")).alias("unpaired"))


def lpt_3(spark, d):
    nbody_dir(spark)
    out = lpt.displacements(_potential(spark, d, MESH).checkpoint(), MESH, 3)
    return out.select("id", *[q(c).alias(c) for c in out.columns if c != "id"])


def nbody_dir(spark: SparkSession) -> None:
    """A folder for checkpoints where none is set, for a local master only."""
    sc = spark.sparkContext
    if not (sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()):
        import tempfile

        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp())


def ppt_free(spark, d):
    nbody_dir(spark)
    phi = X.backward(_potential(spark, d, MESH), MESH).checkpoint()
    out, _ = ppt.propagate(phi, MESH, 0.5, growth_rate=0.8, lyman=(1.0, 1.6))
    return out.select(*MESH.cells, *[q(c).alias(c) for c in out.columns if c not in MESH.cells])


def nbody_1d(spark, d):
    nbody_dir(spark)
    times = eds()
    w = initial.plane_wave(times, LINE, 0.05, a_cross=0.8)
    state = M.lagrangian_grid(spark, LINE).select("id", (w["x"] - F.col("qx")).alias("sx"), (w["px"] / float(times.fplus(0.05))).alias("vx"))
    out = nbody.run(state, LINE, times, nbody.step_times(times, 0.05, 0.5, 3), "bullfrog", "exact")
    return out.select("id", q("sx", 7).alias("sx"), q("vx", 6).alias("vx"))


def nbody_3d(spark, d):
    nbody_dir(spark)
    times = C.Times.of(PLANCK)
    orders = lpt.displacements(_potential(spark, d, MESH).checkpoint(), MESH, 2)
    psi, pi = (lpt.evaluated(orders, MESH, times, 0.1, 2, what) for what in ("psi", "D"))
    state = psi.join(pi.select("id", *[F.col(f"s{x}").alias(f"v{x}") for x in "xyz"]), "id").checkpoint()
    out = nbody.run(state, MESH, times, nbody.step_times(times, 0.1, 1.0, 3), "bullfrog", "pm", MESH.at(16))
    return out.select("id", *[q(c, 5).alias(c) for c in out.columns if c != "id"])


def sheet_resampled(spark, d):
    step = 2 * math.pi / N
    psi = M.grid(spark, MESH).select("id", (2 * F.sin(F.col("ix") * step)).alias("sx"), F.sin(F.col("iy") * step).alias("sy"), F.lit(0.25).alias("sz"))
    return sheet.spawned(psi, MESH, 2).select("shift", "id", *[q(x).alias(x) for x in "xyz"])


def waves_at_places(spark, d):
    places = M.lagrangian_grid(spark, MESH).select("id", (F.col("qx") + 3).alias("x"), F.col("qy").alias("y"), (F.col("qz") + 5).alias("z"))
    return field(X.backward(initial.evaluated_at(field_spectrum(spark, d), MESH, places, 1e-12), MESH))


def growth_eds(spark, d):
    """The growth table where it has a closed form."""
    out = eds().frame(spark).where("a > 0.01")
    return out.select("i", *[q(c, 5).alias(c) for c in ("a", "superconft", "Dplus", "Dplusda", "D2plus", "D3plusa", "D3plusb", "D3plusc")])


def lpt_exact(spark, d):
    """In an Einstein-de Sitter background the parts with their own growth add up to the orders with powers of D."""
    nbody_dir(spark)
    orders = lpt.displacements(_potential(spark, d, MESH).checkpoint(), MESH, 3, split=True).checkpoint()
    both, times = None, C.Times.of(C.EDS, C.a_grid(steps=4096))  # the table is read linearly
    for what in ("psi", "velocity", "D", "acceleration"):
        a, b = (lpt.evaluated(orders, MESH, times, 0.5, 3, what, exact) for exact in (True, False))
        b = b.select("id", *[F.col(f"s{x}").alias(f"o{x}") for x in "xyz"])
        far = F.greatest(*[F.abs(F.col(f"s{x}") - F.col(f"o{x}")) for x in "xyz"])
        one = a.join(b, "id").select("id", (far < 1e-4).alias(what))
        both = one if both is None else both.join(one, "id")
    return both


def growth_table(spark, d):
    out = C.Times.of(PLANCK, C.a_grid(steps=64)).frame(spark)
    return out.select("i", *[q(c, 7).alias(c) for c in out.columns if c != "i"])


def queries() -> dict[str, Query]:
    named = [wrap_positions, min_image, pair_distance, lagrangian_grid, fourier_grid, slice_filter, subsample_stride, glass_detile, deposit_weighted, redshift_shift, cell_velocity, dft_forward, dft_inverse, mak_kernel, deconvolve, poisson, gaussian_split, fourier_crop, fourier_pad, dealiased_product, hermitian_sym, fourier_shift, power_spectrum, cross_spectrum, bispectrum, bispectrum_direct, jacobian_det, e_of_a, sigma8, linear_ps, superconft_table, interp_table, interp_asof, time_maps, plane_wave, zeldovich_1d, exact_acc_1d, dkd_step, morton_3d, multipoles, short_range_pairs, gadget_units, gadget_snapshot, snapshot_series, box_queries, positions_from_psi, dilated_mask, sphere_mode, spectrum_cutoff, field_rescaled, density_from_phi, field_derivative, ngenic_modes, shift_linear, value_at, grid_units, snapshot_stride, spectrum_deviation, spectrum_gradient, force_tangent, user_code, gather_gradient, deposit_tangent, morton_2d, nufft_type2, nufft_force_fine, growth_eds, lpt_exact, sheet_resampled, waves_at_places]
    free = [pencil_fft, skewer, interlaced, redshift_field, nufft_type1, nufft_force, pm_force, mesh_64, tree_pm, short_range_force, tree_walk, gaussian_field, fourier_noise, ngenic_noise, lpt_3, ppt_free, nbody_1d, nbody_3d, growth_table]
    out: dict[str, Query] = {f.__name__: f for f in named + free}
    out |= {f"deposit_{n}": deposit(k) for n, k in (("ngp", 1), ("cic", 2), ("tsc", 3), ("pcs", 4))}
    out |= {f"gather_{n}": gather(k) for n, k in (("cic", 2), ("tsc", 3))}
    out |= {f"grad_kernel_{k}": grad_kernel(k) for k in (0, 2, 4, 6)}
    out |= {f"inv_laplace_{k}": inv_laplace(k) for k in (0, 2, 4, 6)}
    out |= {f"k_order_{k}": k_order(k) for k in ("stable", "natural")}
    out |= {"transfer_eh": transfer("Eisenstein-Hu"), "transfer_bbks": transfer("BBKS"), "transfer_ga": transfer("GeneticAlgorithm")}
    return out


def oracle_sql() -> dict[str, str]:
    return oracle.statements()
