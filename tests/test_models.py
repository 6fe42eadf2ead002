"""Distribution functions, normative models and low-rank models against numpy read literally."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.functions import distributions as D
from cohortry.operators import models as M
from cohortry.operators import normative as N


def area(density, low, high, n=400_001):
    x = np.linspace(low, high, n)
    return float(np.trapezoid(density(x), x))


def test_distributions_equal_integrated_densities(spark):
    for df in (1, 2, 5, 30):
        c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        for t in (-3.0, -0.4, 0.0, 0.7, 2.5):
            assert float(D.t_below(t, df)) == pytest.approx(0.5 + area(lambda x: c * (1 + x * x / df) ** (-(df + 1) / 2), 0, t), abs=1e-8)
            assert float(D.t_quantile(D.t_below(t, df), df)) == pytest.approx(t, abs=1e-7)
    for df in (2, 3, 10):
        c = 2 ** (df / 2) * math.gamma(df / 2)
        for x in (0.1, 1.0, 4.0, 25.0):
            assert float(D.chi2_below(x, df)) == pytest.approx(area(lambda v: v ** (df / 2 - 1) * np.exp(-v / 2) / c, 0, x), abs=1e-6)
    got = spark.createDataFrame([(1.0, 5.0), (None, 5.0), (0.0, 2.0)], "x double, df double").select(D.pt("x", "df").alias("t"), D.pnorm("x").alias("n"), D.pchisq("x", "df").alias("c")).collect()
    assert got[1].t is None and got[1].n is None and got[1].c is None and got[2].t == pytest.approx(0.5) and got[0].n == pytest.approx(0.8413447460685429)


def bspline_free_design(x, sex, knots):
    """A natural cubic spline space by interpolation: cubic splines with zero second derivative at the ends, spanned by cardinal splines."""
    n = len(knots)
    h = np.diff(knots)
    a, b = np.zeros((n, n)), np.zeros((n, n))
    a[0, 0] = a[-1, -1] = 1
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i, i - 1 : i + 2] = 6 / h[i - 1], -6 / h[i - 1] - 6 / h[i], 6 / h[i]
    second = np.linalg.solve(a, b)  # second derivatives at the knots from values there
    out = []
    for v in x:
        i = int(np.clip(np.searchsorted(knots, v) - 1, 0, n - 2))
        u = np.eye(n)
        lo, hi = knots[i], knots[i + 1]
        w = (v - lo) / (hi - lo)
        row = (1 - w) * u[i] + w * u[i + 1] + (hi - lo) ** 2 / 6 * (((1 - w) ** 3 - (1 - w)) * second[i] + (w**3 - w) * second[i + 1])
        if v < knots[0]:
            slope = (u[1] - u[0]) / h[0] - h[0] / 6 * second[1]
            row = u[0] + (v - knots[0]) * slope
        if v > knots[-1]:
            slope = (u[-1] - u[-2]) / h[-1] + h[-1] / 6 * second[-2]
            row = u[-1] + (v - knots[-1]) * slope
        out.append(row)
    return np.column_stack([np.array(out), sex])  # the cardinal splines sum to one, so they hold the constant


@pytest.mark.parametrize("batch", [None, "batch"])
def test_spline_z_equals_least_squares(spark, batch):
    rng = np.random.default_rng(1)
    n = 80
    x, sex, ctrl, b = rng.uniform(5, 30, n), rng.integers(0, 2, n), rng.random(n) < 0.7, rng.integers(0, 3, n)
    values = {place: np.sin(x / 4 + place) + 0.3 * sex + 0.5 * b + rng.normal(0, 0.1, n) for place in (0, 1)}
    rows = spark.createDataFrame([(p, k, float(x[k]), "FM"[sex[k]], bool(ctrl[k]), int(b[k]), float(v[k])) for p, v in values.items() for k in range(n)], "at int, id int, x double, sex string, ctrl boolean, batch int, value double")
    got = {(r["at"], r["id"]): r.z for r in N.spline_z(rows, "ctrl", "at", "x", "sex", ["F", "M"], 3, batch).collect()}
    grid = [(4.0, "F"), (12.0, "M"), (33.0, "M")]
    curves = {(r["at"], r.x, r.sex): r.expected for r in N.normative_curves(rows, grid, "ctrl", "at", "x", "sex", ["F", "M"], 3, batch).collect()}
    inner = np.quantile(x[ctrl], [1 / 3, 2 / 3])
    knots = np.r_[x[ctrl].min(), inner, x[ctrl].max()]
    design = bspline_free_design(x, sex, knots)
    for place, y in values.items():
        if batch:
            y = y - np.array([y[b == k].mean() for k in b])
        fit = design[ctrl]
        beta, *_ = np.linalg.lstsq(fit, y[ctrl], rcond=None)
        free = ctrl.sum() - design.shape[1]
        s = math.sqrt(((y[ctrl] - fit @ beta) ** 2).sum() / free)
        lever = (design @ np.linalg.inv(fit.T @ fit) * design).sum(axis=1)
        want = (y - design @ beta) / (float(D.t_quantile(D.normal_below(1.0), free)) * s * np.sqrt(1 + lever))
        assert [got[place, k] for k in range(n)] == pytest.approx(want.tolist(), abs=1e-6)
        for (p, v, g), e in curves.items():
            if p == place:
                assert e == pytest.approx(float((bspline_free_design([v], [g == "M"], knots) @ beta)[0]), abs=1e-7)


@pytest.mark.parametrize("shift", [0.0, 1e8])
def test_cross_validated_z_equals_refitting(spark, shift):
    rng = np.random.default_rng(4)
    n = 90
    x, sex, ctrl = rng.uniform(5, 30, n), rng.integers(0, 2, n), rng.random(n) < 0.8
    y = shift + np.sin(x / 4) + 0.3 * sex + rng.normal(0, 0.1, n)
    rows = spark.createDataFrame([(0, k, float(x[k]), "FM"[sex[k]], bool(ctrl[k]), float(y[k])) for k in range(n)] + [(0, 900, None, "F", True, 1.0), (0, 901, 7.0, None, True, 1.0), (0, 902, 7.0, "F", None, 1.0)], "at int, id int, x double, sex string, ctrl boolean, value double")
    rows = rows.filter("id < 900 OR id = 902").unionByName(rows.filter("id IN (900, 901)").withColumn("value", F.lit(None).cast("double")))
    done = N.cross_validated_z(rows, "ctrl", "id", "at", "x", "sex", ["F", "M"], 4).collect()
    assert all(r.z is None for r in done if r.id >= 900) and {r.seed for r in done} == {1, 2, 3, 4}
    held = {seed: {r.id: r.z for r in done if r.seed == seed and r.id < 900} for seed in range(1, 5)}
    known = np.append(x[ctrl], 7.0)  # the row without sex has a place among the knots
    design = bspline_free_design(x, sex, np.quantile(known, [0, 1 / 3, 2 / 3, 1]))
    for seed, zs in held.items():
        assert set(zs) <= set(np.flatnonzero(ctrl)) and 0 < len(zs) < ctrl.sum() / 2
        rest = np.array([k for k in np.flatnonzero(ctrl) if k not in zs])
        own, centred = design[rest], y - y[ctrl].mean()
        beta, *_ = np.linalg.lstsq(own, centred[rest], rcond=None)
        s = math.sqrt(((centred[rest] - own @ beta) ** 2).sum() / (len(rest) - own.shape[1]))
        t = float(D.t_quantile(D.normal_below(1.0), len(rest) - own.shape[1]))
        for k, z in zs.items():
            lever = design[k] @ np.linalg.inv(own.T @ own) @ design[k]
            assert z == pytest.approx((centred[k] - design[k] @ beta) / (t * s * math.sqrt(1 + lever)), abs=1e-5)


def test_low_rank_models(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5))
    y = (x[:, 0] + rng.normal(0, 0.5, 60) > 0).astype(int)
    rows = spark.createDataFrame([(k, v.tolist(), int(c)) for k, (v, c) in enumerate(zip(x, y))], "id int, v array<double>, label int").repartition(3)
    mean, scale, loadings, variances = M.principal_components(rows, "v", 2)
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    assert variances == pytest.approx((s[:2] ** 2 / 59).tolist())
    assert np.abs(loadings.T @ vt[:2].T) == pytest.approx(np.eye(2), abs=1e-8)
    scores = {r.id: r.scores for r in M.projected(rows, "v", mean, scale, loadings).collect()}
    assert np.array([scores[k] for k in range(60)]) == pytest.approx(z @ loadings, abs=1e-8)
    weights, cut = M.linear_discriminant(rows, "v", "label")
    within = sum(np.cov(x[y == k].T, ddof=0) * (y == k).sum() for k in (0, 1)) / 58
    assert weights == pytest.approx(np.linalg.solve(within, x[y == 1].mean(axis=0) - x[y == 0].mean(axis=0)))
    assert ((x @ weights > cut) == (y == 1)).mean() > 0.8
    mean, scale, rotations = M.partial_least_squares(rows, "v", "label", 2)
    t = z @ rotations
    assert abs(np.corrcoef(t.T)[0, 1]) < 1e-8 and abs(np.corrcoef(t[:, 0], y)[0, 1]) > 0.5
    first = z.T @ (y - y.mean())
    assert np.abs(first / np.linalg.norm(first)) == pytest.approx(np.abs(rotations[:, 0]), abs=1e-8)
    with pytest.raises(ValueError):
        M.linear_discriminant(rows.filter(F.col("label") == 1), "v", "label")
