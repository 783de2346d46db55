"""Local curves, bands and regression splines against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from baroflow.operators.curves import choose_penalty, local_curves, regression_spline, t_quantile
from baroflow.operators.fit import grid_points, kde_2d, local_regression
from baroflow.operators.surfaces import local_surfaces
from baroflow.plans.staging import stage

COLUMNS = "half string, `X` double, y double, k long"


def frame(spark, p):
    p = p.astype(object).where(p.notna(), None)
    return spark.createDataFrame([tuple(r) for r in p.itertuples(index=False)], COLUMNS).repartition(3)


def sample(seed=1, n=160, digits=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.uniform(-3, 5, n), digits)
    y = np.sin(x) + rng.normal(0, 0.3, n)
    half = np.where(np.arange(n) % 4 == 0, None, np.where(np.arange(n) % 3 == 0, "a", "b"))
    p = pd.DataFrame({"half": half, "x": x, "y": y, "k": 1})
    odd = pd.DataFrame({"half": ["a", "b", "flat", "flat"], "x": [np.nan, 1.0, 2.0, 2.0], "y": [1.0, np.nan, 3.0, 5.0], "k": 1})
    return pd.concat([p, odd], ignore_index=True)


def operator(x, at, span=0.75, degree=2):
    """Rows of the operator matrix at ``at``, and the slopes'."""
    rows = []
    for a in at:
        d = np.abs(x - a)
        r = np.sort(d)[max(1, int(span * len(x) + 1e-9)) - 1]
        w = np.clip(1 - (d / r) ** 3, 0, None) ** 3
        b = np.vander(x - a, degree + 1, increasing=True)
        rows.append((np.linalg.pinv(b.T @ (w[:, None] * b), rcond=1e-14) @ (b.T * w))[:2])
    return np.array(rows)


@pytest.mark.parametrize("degree", [1, 2])
def test_band_from_the_operator_matrix(spark, degree):
    p = sample()
    got = local_curves(frame(spark, p), "X", "y", ["half"], degree=degree, count=15, band=0.9).toPandas()
    assert set(got.columns) == {"half", "X", "fit", "se", "low", "high"} and len(got) == 4 * 15
    for half in ("a", "b", None):
        own = p[(p.half.isna() if half is None else p.half == half) & p.x.notna() & p.y.notna()]
        g = got[got.half.isna() if half is None else got.half == half].sort_values("X")
        x, y = own.x.to_numpy(), own.y.to_numpy()
        assert np.allclose(g["X"], np.linspace(x.min(), x.max(), 15))
        there = operator(x, x, degree=degree)[:, 0]
        row = operator(x, g["X"].to_numpy(), degree=degree)[:, 0]
        rss = ((y - there @ y) ** 2).sum()
        left = len(x) - 2 * np.trace(there) + (there**2).sum()
        se = np.sqrt(rss / left * (row**2).sum(1))
        assert np.allclose(g.fit, row @ y, atol=1e-8) and np.allclose(g.se, se, atol=1e-8)
        t = spark.range(1).select(t_quantile(0.9, F.lit(float(left)))).first()[0]
        assert np.allclose(g.high - g.fit, t * se, atol=1e-8) and np.allclose(g.fit - g.low, t * se, atol=1e-8)
    flat = got[got.half == "flat"]
    assert np.allclose(flat.fit, 4.0) and len(flat) == 15


def test_band_with_fewer_positions_than_values(spark):
    p = sample(3, 400, 9)
    exact = local_curves(frame(spark, p), "X", "y", ["half"], count=9, band=0.95).toPandas()
    lattice = local_curves(frame(spark, p), "X", "y", ["half"], count=9, band=0.95, positions=60).toPandas()
    both = exact.merge(lattice, on=["half", "X"], suffixes=("", "_l"))
    both = both[both.half != "flat"]
    assert np.allclose(both.fit, both.fit_l) and np.allclose(both.se, both.se_l, rtol=2e-2)


def test_student_quantiles(spark):
    # Fixed values of the distribution: 95 % two-sided for 3, 10 and 60 degrees of freedom.
    for df, want, tolerance in ((3.0, 3.182446, 2e-2), (10.0, 2.228139, 1e-4), (60.0, 2.000298, 1e-6)):
        assert spark.range(1).select(t_quantile(0.95, F.lit(df))).first()[0] == pytest.approx(want, abs=tolerance)


def test_empty_tables_have_no_curve(spark):
    none = frame(spark, sample()).limit(0)
    assert local_curves(none, "X", "y", ["half"], band=0.95).count() == 0
    assert regression_spline(none, "X", "y", band=0.95).count() == 0


def spline_space(knots, x):
    """Natural cubic splines in truncated powers, and their second derivatives' products integrated."""
    last, before = knots[-1], knots[-2]
    cube = lambda v: np.clip(v, 0, None) ** 3
    d = lambda v, k: (cube(v - k) - cube(v - last)) / (last - k)
    n = np.stack([np.ones(len(x)), x] + [d(x, k) - d(x, before) for k in knots[:-2]], 1)
    lin = lambda v, k: 6 * (np.clip(v - k, 0, None) - np.clip(v - last, 0, None)) / (last - k)
    rough = np.zeros((len(knots), len(knots)))
    for a, b in zip(knots, knots[1:]):
        for v, w in ((a, 1), ((a + b) / 2, 4), (b, 1)):
            second = np.array([0, 0] + [lin(v, k) - lin(v, before) for k in knots[:-2]])
            rough += np.outer(second, second) * w * (b - a) / 6
    return n, rough


def test_regression_spline_in_another_basis(spark):
    p = sample(5, 300)
    got = regression_spline(frame(spark, p), "X", "y", ["half"], basis=7, penalty=0.8, count=11, band=0.95).toPandas()
    assert set(got.half.fillna("none")) == {"a", "b", "none"}  # one value of x has no curve
    for half in ("a", "b", None):
        own = p[(p.half.isna() if half is None else p.half == half) & p.x.notna() & p.y.notna()]
        g = got[got.half.isna() if half is None else got.half == half].sort_values("X")
        x, y = own.x.to_numpy(), own.y.to_numpy()
        knots = np.quantile(np.unique(x), np.linspace(0, 1, 7))
        n, rough = spline_space(knots, x)
        at = spline_space(knots, g["X"].to_numpy())[0]
        inverse = np.linalg.inv(n.T @ n + 0.8 * rough)
        beta = inverse @ n.T @ y
        left = len(x) - np.trace(inverse @ n.T @ n)
        se = np.sqrt(((y - n @ beta) ** 2).sum() / left * np.einsum("gi,ij,gj->g", at, inverse, at))
        assert np.allclose(g.fit, at @ beta, atol=1e-6) and np.allclose(g.se, se, atol=1e-6)


def test_penalty_has_the_least_score():
    rng = np.random.default_rng(0)
    x = np.sort(rng.uniform(0, 1, 200))
    y = np.sin(6 * x) + rng.normal(0, 0.2, 200)
    n, rough = spline_space(np.quantile(x, np.linspace(0, 1, 8)), x)
    a, b = n.T @ n, n.T @ y

    def score(weight):
        hat = n @ np.linalg.solve(a + weight * rough, n.T)
        return 200 * ((y - hat @ y) ** 2).sum() / (200 - np.trace(hat)) ** 2

    best = choose_penalty(a, b, y @ y, 200, rough)
    assert all(score(best) <= score(best * f) * (1 + 1e-6) for f in (0.01, 0.3, 0.9, 1.1, 3, 100))


def test_surface_is_near_the_direct_fit(spark):
    rng = np.random.default_rng(4)
    n = 600
    p = pd.DataFrame({"t": rng.normal(15, 8, n), "p": rng.normal(0, 20, n)})
    p["z"] = np.clip(0.5 + 0.01 * p.p + 0.01 * p.t * np.sin(p.t / 6) + rng.normal(0, 0.2, n), 0, 1)
    p["half"] = np.where(np.arange(n) % 2, "a", None)
    df = stage(spark.createDataFrame([tuple(r) for r in p.itertuples(index=False)], "t double, p double, z double, half string"), "surface")
    axes = [(0.0, 30.0, 2.0), (-40.0, 40.0, 5.0)]
    got = local_surfaces(df, ["t", "p"], "z", axes, ["half"]).toPandas()
    coarse = local_surfaces(df, ["t", "p"], "z", [(0.0, 30.0, 30.0), (-40.0, 40.0, 80.0)], ["half"]).toPandas()
    assert len(coarse) == 2 * 4 and len(got) == 2 * 16 * 17
    for half in ("a", None):
        own = df.where(F.col("half").eqNullSafe(F.lit(half)))
        want = local_regression(own, ["t", "p"], "z", grid_points(axes), 0.7).toPandas()
        mine = got[got.half.isna() if half is None else got.half == half].merge(want, on=["t", "p"], suffixes=("", "_direct"))
        error = (mine.fit - mine.fit_direct).abs()
        assert len(mine) == 16 * 17 and error.max() < 2e-3 and error.mean() < 3e-4
        # The vertices, and so the corners, do not depend on the grid's steps.
        corner = coarse[coarse.half.isna() if half is None else coarse.half == half].merge(want, on=["t", "p"])
        assert np.allclose(corner.fit_x, corner.fit_y, atol=1e-7)


def test_surface_reproduces_a_quadratic_far_from_the_data(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b), float(1 + a - 2 * b + 0.5 * a * b + a * a), "x") for a, b in rng.uniform(-1, 1, (80, 2))]
    rows += [(None, 1.0, 1.0, "x"), (1.0, 1.0, None, "x"), (3.0, 3.0, 2.0, "one row")]
    df = spark.createDataFrame(rows, "t double, p double, z double, half string")
    got = local_surfaces(df, ["t", "p"], "z", [(-4.0, 4.0, 1.0), (-6.0, 6.0, 1.5)], ["half"]).toPandas()
    mine = got[got.half == "x"]
    assert np.allclose(mine.fit, 1 + mine.t - 2 * mine.p + 0.5 * mine.t * mine.p + mine.t**2, atol=1e-6)
    assert local_surfaces(df.limit(0), ["t", "p"], "z", [(0.0, 1.0, 1.0)] * 2, ["half"]).count() == 0


def test_density_per_group(spark):
    p = sample(7, 90)
    got = kde_2d(frame(spark, p), "X", "y", 5, ["half"]).toPandas()
    assert len(got) == 4 * 25
    alone = kde_2d(frame(spark, p[p.half == "a"]), "X", "y", 5).toPandas().sort_values(["i", "j"])
    own = p[(p.half == "a") & p.x.notna() & p.y.notna()]
    h = [1.06 * min(v.std(), (np.quantile(v, 0.75) - np.quantile(v, 0.25)) / 1.34) * len(v) ** -0.2 for v in (own.x, own.y)]
    grid = [np.linspace(v.min(), v.max(), 5) for v in (own.x, own.y)]
    k = [np.exp(-0.5 * ((g[:, None] - v.to_numpy()) / w) ** 2) / (w * np.sqrt(2 * np.pi)) for g, v, w in zip(grid, (own.x, own.y), h)]
    want = (k[0] @ k[1].T / len(own)).ravel()
    assert np.allclose(alone.density, want) and np.allclose(got[got.half == "a"].sort_values(["i", "j"]).density, want)
