"""Operators against numpy, and properties that must hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshweave.functions import cosmology as C
from meshweave.operators import fourier as X
from meshweave.operators import mesh as M
from meshweave.operators import nufft, particles as P, statistics, tree
from meshweave.plans import initial, lpt, nbody, ppt, sheet
from meshweave.sources import files, ranlux
from meshweave.session import Universe

MESH = M.Mesh(3, 8, 100.0)


def array(df, names, value="v", n=8):
    r = df.toPandas()
    out = np.zeros((n,) * len(names))
    out[tuple(r[c] for c in names)] = r[value]
    return out


@pytest.fixture(scope="module")
def points():
    return np.random.default_rng(0).random((300, 3)) * 140 - 20


@pytest.fixture(scope="module")
def frame(spark, points):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(points)], "id long, x double, y double, z double")


def share(d, order):
    d = np.abs(d)
    return {2: np.maximum(0, 1 - d), 3: np.where(d <= 0.5, 0.75 - d * d, np.where(d <= 1.5, (1.5 - d) ** 2 / 2, 0)), 4: np.where(d <= 1, (4 - 6 * d**2 + 3 * d**3) / 6, np.where(d <= 2, (2 - d) ** 3 / 6, 0))}[order]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_deposit(frame, points, order):
    g, want = (points % 100) * 8 / 100, np.zeros((8, 8, 8))
    for a in range(-3, 12):
        for b in range(-3, 12):
            for c in range(-3, 12):
                want[a % 8, b % 8, c % 8] += (share(g[:, 0] - a, order) * share(g[:, 1] - b, order) * share(g[:, 2] - c, order)).sum()
    assert np.abs(array(P.deposit(frame, MESH, order), MESH.cells) - want).max() < 1e-12


def test_transforms_agree(frame):
    delta = P.overdensity(frame, MESH)
    field = array(delta, MESH.cells)
    assert abs(field.sum()) < 1e-9
    want = np.fft.fftn(field)
    for method in ("sql", "slab", "pencil"):
        s = X.forward(delta, MESH, method=method)
        assert np.abs(array(s, MESH.modes, "re") - want.real).max() < 1e-11
        assert np.abs(array(X.backward(s, MESH, method=method), MESH.cells) - field).max() < 1e-12
    half = M.half(X.forward(delta, MESH), MESH)
    assert np.abs(array(X.backward(X.full_from_half(X.hermitian(half, MESH), MESH), MESH), MESH.cells) - field).max() < 1e-12
    again = X.density(X.potential(delta, MESH), MESH)
    assert np.abs(array(again, MESH.cells) - field).max() < 1e-11


def test_gather_is_the_adjoint_of_deposit(spark, frame):
    field = P.overdensity(frame, MESH)
    left = P.gather(field, frame, MESH).agg(F.sum("v")).first()[0]
    right = (array(field, MESH.cells) * array(P.deposit(frame, MESH), MESH.cells)).sum()
    assert left == pytest.approx(right)


def test_deposit_tangent_and_adjoint(spark, frame):
    moving = frame.withColumns({"tx": F.sin("id"), "ty": F.cos("id"), "tz": F.lit(0.3)})
    tangent = P.deposit_tangent(moving, MESH, 3)
    eps = 1e-5
    nudge = lambda s: array(P.deposit(moving.withColumns({x: F.col(x) + s * eps * F.col(f"t{x}") for x in "xyz"}), MESH, 3), MESH.cells)
    assert np.abs((nudge(1) - nudge(-1)) / (2 * eps) - array(tangent, MESH.cells, "dv")).max() < 1e-7
    cotangent = M.grid(spark, MESH).select(*MESH.cells, F.sin("id").alias("v"))
    back = P.deposit_adjoint(cotangent, frame, MESH, 3).join(moving, "id").agg(F.sum(F.col("gx") * F.col("tx") + F.col("gy") * F.col("ty") + F.col("gz") * F.col("tz"))).first()[0]
    assert back == pytest.approx((array(cotangent, MESH.cells) * array(tangent, MESH.cells, "dv")).sum())


def test_slice_equals_whole(frame):
    frame = frame.select("id", *[M.wrap(F.col(x), 100.0).alias(x) for x in "xyz"])
    whole = array(P.overdensity(frame, MESH), MESH.cells)
    part = P.on_slice(frame, MESH, (3, (2, 6))).toPandas()
    got = np.zeros((4, 8))
    got[part.iy, part.iz] = part.v
    assert np.abs(got - whole[3, 2:6]).max() < 1e-12


def test_shift_by_whole_cells(frame):
    delta = P.overdensity(frame, MESH)
    field = array(delta, MESH.cells)
    for how in ("fourier", "linear"):
        assert np.abs(array(X.shifted(delta, MESH, (12.5, 0, 25.0), how), MESH.cells) - np.roll(field, (-1, 0, -2), (0, 1, 2))).max() < 1e-12


def test_crop_after_pad(spark):
    w = M.grid(spark, MESH).select(*MESH.cells, F.sin("id").alias("v"))
    s = X.forward(w, MESH)
    back = M.crop(M.pad(s, MESH, MESH.at(12), keep_mean=True), MESH, MESH.at(12))
    assert np.abs(array(back, MESH.modes, "re")[:4, :4, :4] - array(s, MESH.modes, "re")[:4, :4, :4]).max() < 1e-10


def test_growth_in_a_matter_universe():
    t = C.Times.of(C.EDS, C.a_grid(1e-3, 1, 100)).columns
    a = t["a"]
    for name, want in (("Dplus", a), ("D2plus", -3 / 7 * a**2), ("D3plusa", a**3 / 3), ("D3plusb", -10 / 21 * a**3), ("D3plusc", a**3 / 7), ("superconft", -2 * (a**-0.5 - 1))):
        assert np.abs(t[name] - want).max() < 1e-8, name
    with pytest.raises(ValueError):
        C.a_grid(1.0, 0.5)


def test_spectrum_is_normalised(spark, tmp_path):
    pk = C.linear_spectrum(spark, C.PLANCK15, 100.0, 8)
    assert C.sigma_squared(pk).first()[0] ** 0.5 == pytest.approx(0.8159)
    files.write_spectrum(pk, f"file://{tmp_path}/pk")
    assert files.read_spectrum(spark, f"file://{tmp_path}/pk").count() == 1000


def test_plane_wave_is_exact(spark):
    line, t = M.Mesh(1, 64, 1.0), C.Times.of(C.EDS, C.a_grid(1e-3, 1, 300))
    w, end = initial.plane_wave(t, line, 0.05, 0.8), initial.plane_wave(t, line, 0.5, 0.8)
    q = M.lagrangian_grid(spark, line)
    state = q.select("id", (w["x"] - F.col("qx")).alias("sx"), (w["px"] / float(t.fplus(0.05))).alias("vx"))
    want = q.select("id", (end["x"] - F.col("qx")).alias("sx")).toPandas().sort_values("id").sx.to_numpy()
    times = nbody.step_times(t, 0.05, 0.5, 2)
    for stepper in ("bullfrog", "fastpm"):
        got = nbody.run(state, line, t, times, stepper, "exact").toPandas().sort_values("id").sx.to_numpy()
        assert np.abs(got - want).max() < 1e-12
    step = nbody.coefficients(t, times)[0]
    there = nbody.one_step(state, line, line, step, "exact")
    back = nbody.inverse_step(there, line, line, step, "exact").toPandas().sort_values("id").sx.to_numpy()
    assert np.abs(back - state.toPandas().sort_values("id").sx.to_numpy()).max() < 1e-12


def test_second_order(spark):
    mesh = M.Mesh(3, 8, 50.0)
    phi = initial.gaussian_potential(spark, mesh, C.linear_spectrum(spark, C.PLANCK15, 50.0, 8), seed=3).checkpoint()
    d = lpt.displacements(phi, mesh, 2).toPandas().sort_values("id")
    z = array(phi, mesh.modes, "re") + 1j * array(phi, mesh.modes, "im")
    k = 2 * np.pi / 50 * np.fft.fftfreq(8, 1 / 8)
    k0 = np.where(np.arange(8) == 4, 0, k)
    K, full = np.meshgrid(k0, k0, k0, indexing="ij"), sum(x * x for x in np.meshgrid(k, k, k, indexing="ij"))
    full[0, 0, 0] = 1
    keep = np.array([0, 1, 2, 3, -3, -2, -1])
    up = lambda f: _embed(f, keep, 12)
    g = {(a, b): np.fft.ifftn(up(K[b] * K[a] * z)).real for a in range(3) for b in range(3)}
    mu = np.fft.fftn(sum(g[a, a] * g[b, b] - g[a, b] ** 2 for a in range(3) for b in range(a + 1, 3)))
    low = np.zeros((8, 8, 8), complex)
    low[np.ix_(keep, keep, keep)] = mu[np.ix_(keep, keep, keep)] * (8 / 12) ** 3
    want = np.fft.ifftn(-1j * K[0] * (-3 / 7 * low) / full).real
    assert np.abs(want.ravel() - d.s2x.to_numpy()).max() < 1e-12


def _embed(f, keep, n):
    out = np.zeros((n,) * 3, complex)
    out[np.ix_(keep, keep, keep)] = f[np.ix_(keep, keep, keep)] * (n / 8) ** 3
    return out


def test_nufft_matches_its_definition(spark, points):
    flat = M.Mesh(2, 8, 100.0)
    df = spark.createDataFrame([(i, float(r[0]), float(r[1]), 1.0) for i, r in enumerate(points[:50])], "id long, x double, y double, re double")
    a, b = nufft.type1(df, flat), nufft.direct(df, flat)
    for c in ("re", "im"):
        assert np.abs(array(a, flat.modes, c) - array(b, flat.modes, c)).max() < 1e-4


def test_short_range_tree_matches_pairs(spark, frame):
    pairs = tree.short_range_force(frame, MESH, 3.0).toPandas().sort_values("id").ax.to_numpy()
    walk = tree.tree_force(frame, MESH, 3.0, theta=1e-6, bits=3, leaf=4).toPandas().sort_values("id").ax.to_numpy()
    assert np.abs(pairs - walk).max() < 1e-9 * max(1, np.abs(pairs).max())


def test_morton_round_trip(spark):
    df = spark.range(512).select(*[c.alias(n) for c, n in zip(M.index_columns(F.col("id"), MESH, list("abc")), "abc")])
    key = tree.morton([F.col(c) for c in "abc"], 3)
    back = df.withColumn("k", key).select("*", *[c.alias(f"u{n}") for n, c in enumerate(tree.unmorton(F.col("k"), 3, 3))])
    assert back.where("a <> u0 OR b <> u1 OR c <> u2").count() == 0
    assert back.select("k").distinct().count() == 512


def test_statistics(spark, frame):
    delta = P.overdensity(frame, MESH)
    same = statistics.cross_spectrum(delta, delta, MESH, 5).toPandas()
    assert np.allclose(same.x, 1)
    e = statistics.eigenvalues(spark.createDataFrame([(2.0, 1.0, 0.0, 1.0, 3.0, 0.5, 0.0, 0.5, 1.0)], ", ".join(f"m{a}{b} double" for a in range(3) for b in range(3))), 3).first()
    assert np.allclose([e.e0, e.e1, e.e2], np.linalg.eigvalsh([[2, 1, 0], [1, 3, 0.5], [0, 0.5, 1]]))
    b = statistics.bispectrum(delta, MESH, 2).toPandas()
    assert (b.triangles > 0).all() and len(b) == len(statistics.triangles(MESH, 2))


def test_wave_function_keeps_mass(spark):
    mesh = M.Mesh(2, 8, 10.0)
    phi = M.grid(spark, mesh).select(*mesh.cells, F.cos(F.col("ix") * (np.pi / 4)).alias("v"))
    out, h = ppt.propagate(phi, mesh, 0.3, growth_rate=1.0, lyman=(1.0, 1.6))
    r = out.toPandas()
    assert h > 0 and abs(r.delta.mean()) < 1e-12 and abs(r.delta_rsd.mean()) < 1e-12


def test_sources(spark, tmp_path, frame):
    state = frame.withColumns({f"p{x}": F.lit(0.5) for x in "xyz"})
    units = files.to_units(state, MESH, 0.25, 0.7)
    assert np.allclose(files.from_units(units.withColumns({f"v{x}": F.col(f"v{x}") * 0.25**0.5 for x in "xyz"}), MESH, 0.25).select("px").first()[0], 0.5)
    header = files.Header(0.25, 100.0, 300, 0.3, 0.7, 0.7)
    files.write_snapshot(units, header, f"file://{tmp_path}/snap")
    rows, again = files.read_snapshot(spark, f"file://{tmp_path}/snap")
    assert rows.count() == 300 and again == header
    placed = spark.range(4096).select(M.detile(F.col("id"), 2, 8).alias("p"))
    assert placed.distinct().count() == 4096
    assert ranlux.ngenic_noise(spark, MESH, 7).count() == 7 * 7 * 4 - 1
    # the field of the spectrum is real, and its own transform is the spectrum again
    field = ranlux.ngenic_field(spark, MESH, [7, 8]).toPandas()
    assert len(field) == 2 * 512 and field.groupby("seed").v.std().between(0.5, 1.5).all()
    v = field[field.seed == 7].sort_values(["ix", "iy", "iz"]).v.to_numpy().reshape(8, 8, 8)
    noise = ranlux.ngenic_noise(spark, MESH, 7).toPandas()
    assert np.allclose(np.fft.rfftn(v)[noise.jx, noise.jy, noise.jz], noise.re + 1j * noise.im)


@pytest.mark.parametrize("dim", [1, 2, 3])
def test_mode_ranks_are_those_of_a_sort(spark, dim):
    mesh = M.Mesh(dim, 8, 1.0)
    modes = M.fourier_grid(spark, mesh)
    place = lambda j: [0, 1, 3, 5, 7, 6, 4, 2][j]
    for kind in ("stable", "natural"):
        got = X.mode_order(modes, mesh, kind).toPandas()
        keys = [(*(place(j) for j in r[:-1]), max(2 * r[-1] - 1, 0)) for r in got[list(mesh.modes)].to_numpy().tolist()]
        order = sorted(range(len(keys)), key=lambda k: (max(keys[k]), *keys[k]) if kind == "stable" else keys[k])
        assert got["rank"].iloc[order].tolist() == list(range(len(keys)))


def test_ranlux_is_uniform():
    u = [ranlux.Ranlxd(1).uniform() for _ in range(3)]
    assert all(0 <= x < 1 for x in u)


def test_session(spark):
    u = Universe(spark, M.Mesh(2, 8, 50.0)).with_times(steps=64).with_spectrum().with_initial(seed=2, deviation=0.5).with_lpt(2)
    assert u.initial_density().agg(F.stddev_pop("v")).first()[0] == pytest.approx(0.5)
    assert u.positions(0.5).count() == 64
    assert u.nbody(0.1, 0.5, 2).count() == 64
    assert sheet.spawned(u.displacement(0.5), u.mesh, 2).count() == 256
    with pytest.raises(ValueError):
        u.with_external()
    with pytest.raises(ValueError):
        M.Mesh(3, 7, 1.0)


def test_empty_and_edge_particles(spark):
    at = spark.createDataFrame([(0, 0.0, 100.0, -50.0), (1, 12.5, 250.0, 99.999999)], "id long, x double, y double, z double")
    assert P.deposit(at, MESH, 3).agg(F.sum("v")).first()[0] == pytest.approx(2)
    none = at.where("id > 5")
    assert P.deposit(none, MESH).agg(F.sum("v")).first()[0] == 0


def test_reverse_derivative_of_a_run(spark):
    from meshweave.plans import adjoint

    mesh, grid = M.Mesh(2, 4, 10.0), M.Mesh(2, 8, 10.0)
    rng = np.random.default_rng(4)
    start = rng.normal(size=(16, 4)) * 0.3
    frame = lambda a: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(a)], "id long, sx double, sy double, vx double, vy double")
    steps = [nbody.Step(0.9, 0.4, 0.2, 0.3), nbody.Step(0.8, 0.5, 0.25, 0.2)]

    def forward(a):
        state = frame(a)
        for s in steps:
            state = nbody.one_step(state, mesh, grid, s, "pm", order=3)
        return state

    weights = rng.normal(size=(16, 4))
    value = lambda a: float((forward(a).toPandas().sort_values("id")[["sx", "sy", "vx", "vy"]].to_numpy() * weights).sum())
    g = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(weights)], "id long, gsx double, gsy double, gvx double, gvy double")
    first, back = adjoint.run_adjoint(forward(start).checkpoint(), g, mesh, grid, steps, 3)
    assert np.abs(first.toPandas().sort_values("id")[["sx", "sy", "vx", "vy"]].to_numpy() - start).max() < 1e-9
    direction, eps = rng.normal(size=(16, 4)), 1e-5
    want = (value(start + eps * direction) - value(start - eps * direction)) / (2 * eps)
    got = float((back.toPandas().sort_values("id")[["gsx", "gsy", "gvx", "gvy"]].to_numpy() * direction).sum())
    assert got == pytest.approx(want, rel=1e-5)


def test_bullfrog_from_zero_and_from_momenta(spark):
    line, times = M.Mesh(1, 64, 1.0), C.Times.of(C.EDS)
    k, x = 2 * np.pi, np.arange(64) / 64
    want = 0.5 / 0.8 * np.sin(k * x) / k
    first = M.lagrangian_grid(spark, line).select("id", F.lit(0.0).alias("sx"), (F.sin(F.col("qx") * k) / (k * 0.8)).alias("vx"))
    got = nbody.run(first, line, times, nbody.step_times(times, 0.0, 0.5, 3), "bullfrog", "exact").orderBy("id").toPandas()
    assert np.allclose(got.sx, want, atol=1e-9)
    wave = initial.plane_wave(times, line, 0.05, a_cross=0.8)
    start = M.lagrangian_grid(spark, line).select("id", M.wrap(wave["x"], 1.0).alias("x"), wave["px"].alias("px"))
    got = Universe(spark, line, C.EDS, times).nbody(0.05, 0.5, 3, method="exact", start=start).orderBy("id").toPandas()
    assert np.allclose(got.sx, want, atol=1e-9)
    with pytest.raises(ValueError):
        nbody.coefficients(times, np.array([0.0, 0.5]), "fastpm")


def test_parts_of_a_force(spark, frame):
    u = Universe(spark, MESH)
    long, short, both = (u.acceleration(frame, method="treepm", alpha=12.0, part=p).orderBy("id").toPandas() for p in ("long", "short", "both"))
    assert np.allclose(both.ax, long.ax + short.ax)
    mesh = u.acceleration(frame, on_mesh=True)
    assert mesh.count() == MESH.size and np.allclose(P.gather(mesh, frame, MESH, 2, ("ax",)).orderBy("id").toPandas().ax, u.acceleration(frame).orderBy("id").toPandas().ax)


def test_forces_generate_small_code(spark, frame):
    plan = P.spread(frame, MESH, 4, slopes=True)._jdf.queryExecution()
    sizes = [s.split(" ")[0] for s in spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan.executedPlan()).split("maxMethodCodeSize:")[1:]]
    assert sizes and all(int(s.strip(";)")) < 8000 for s in sizes)
