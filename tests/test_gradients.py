"""Derivatives of spectra and forces against finite differences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshweave.operators import particles as P
from meshweave.operators import statistics
from meshweave.operators.mesh import Mesh
from meshweave.plans import gradients, nbody


def frame(spark, x, t=None):
    axes = "xyz"[: x.shape[1]]
    rows = [(i, *map(float, p), *(map(float, t[i]) if t is not None else ())) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "id long, " + ", ".join([*[f"{a} double" for a in axes], *([f"t{a} double" for a in axes] if t is not None else [])]))


@pytest.mark.parametrize(("mesh", "order"), [(Mesh(3, 8, 20.0), 3), (Mesh(2, 12, 20.0), 4), (Mesh(1, 32, 20.0), 3)])
def test_gradient_of_a_spectrum(spark, mesh, order):
    rng = np.random.default_rng(mesh.dim)
    x, weights, edges = rng.uniform(0, 20, (40, mesh.dim)), [1.0, -2.0, 0.5], (0.1, 0.8, 1.5, 2.5)

    def weighted(x):
        delta = P.overdensity(frame(spark, x), mesh, order)
        pk = {r["bin"]: r["pk"] for r in statistics.power_spectrum(delta, mesh, edges).collect()}
        return sum(w * pk.get(b, 0.0) for b, w in enumerate(weights))

    rows = gradients.spectrum_gradient(frame(spark, x), mesh, weights, edges, order).toPandas().sort_values("id")
    g = rows[[f"g{a}" for a in "xyz"[: mesh.dim]]].to_numpy()
    assert len(g) == 40
    for _ in range(2):
        step = rng.normal(size=x.shape)
        h = 1e-5
        slope = (weighted(x + h * step) - weighted(x - h * step)) / (2 * h)
        assert np.isclose((g * step).sum(), slope, rtol=1e-5, atol=1e-6 * np.abs(g).max())


@pytest.mark.parametrize("options", [{}, {"deconvolve": True, "gradient_order": 4, "laplace_order": 2}, {"alpha": 2.0}])
def test_tangent_of_a_force(spark, options):
    mesh, rng = Mesh(3, 8, 20.0), np.random.default_rng(7)
    x, t = rng.uniform(0, 20, (60, 3)), rng.normal(size=(60, 3))
    out = gradients.force_tangent(frame(spark, x, t), mesh, 3, **options).toPandas().sort_values("id")
    force = lambda x: nbody.pm_force(frame(spark, x), mesh, 3, **options).toPandas().sort_values("id")[["ax", "ay", "az"]].to_numpy()
    h = 1e-5
    slope = (force(x + h * t) - force(x - h * t)) / (2 * h)
    assert np.allclose(out[["ax", "ay", "az"]].to_numpy(), force(x), atol=1e-10)
    assert np.allclose(out[["tax", "tay", "taz"]].to_numpy(), slope, rtol=1e-4, atol=1e-5 * np.abs(slope).max())


def test_tangent_through_a_step(spark):
    """Drift, kick, drift with the tangent of the library's own force."""
    lattice, step, rng = Mesh(3, 4, 20.0), nbody.Step(0.9, 0.7, 0.3, 0.4), np.random.default_rng(1)
    s, v, ds, dv = (rng.normal(size=(64, 3)) for _ in range(4))
    names = [f"{p}{a}" for p in ("s", "v", "ts", "tv") for a in "xyz"]

    def state(s, v, ds, dv):
        return spark.createDataFrame([(i, *map(float, (*s[i], *v[i], *ds[i], *dv[i]))) for i in range(64)], "id long, " + ", ".join(f"{n} double" for n in names))

    def after(h):
        out = nbody.one_step(state(s + h * ds, v + h * dv, ds, dv).drop(*names[6:]), lattice, Mesh(3, 8, 20.0), step, order=3)
        return out.toPandas().sort_values("id")[names[:6]].to_numpy()

    got = nbody.tangent_step(state(s, v, ds, dv), lattice, step, grid=Mesh(3, 8, 20.0), order=3).toPandas().sort_values("id")
    h = 1e-5
    slope = (after(h) - after(-h)) / (2 * h)
    assert np.allclose(got[names[6:]].to_numpy(), slope, rtol=1e-4, atol=1e-5 * np.abs(slope).max())


def test_no_place_no_row(spark):
    df = spark.createDataFrame([(1, 1.0, None, 2.0), (2, 3.0, 4.0, 5.0)], "id long, x double, y double, z double")
    out = gradients.spectrum_gradient(df, Mesh(3, 8, 20.0), [1.0], (0.1, 2.0), 3).collect()
    assert [r["id"] for r in out] == [2]
    with pytest.raises(ValueError, match="weights"):
        gradients.spectrum_adjoint(df.select(F.lit(0).alias("ix")), Mesh(3, 8, 20.0), [1.0, 2.0], (0.1, 2.0))
