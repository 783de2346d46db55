"""Statistics, drought indices and fits against plain numpy or pandas."""

import math
import random
from datetime import datetime, timedelta
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from baroflow.functions import numerics
from baroflow.operators import drought, fit, quantiles, stats
from baroflow.plans.staging import stage
from tests.helpers import T0, series


def test_quantiles_with_one_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot", round(rng.lognormvariate(0, 2), 3)) for _ in range(4000)]
    rows += [("hot", 5.0)] * 3000 + [("neg", rng.uniform(-900, 900)) for _ in range(700)] + [(None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs, names = [0.0, 0.05, 0.5, 0.9, 0.999, 1.0], list("abcdef")
    got = {r.k: [r[n] for n in names] for r in quantiles.exact_quantiles(df, ["k"], "v", probs, names).collect()}
    for k in ("hot", "neg", None):
        want = np.quantile([v for key, v in rows if key == k], probs)
        assert got[k] == pytest.approx(list(want), rel=1e-12)


def test_quantile_bins_split_tiny_and_narrow_values(spark):
    values = [-3e300, -1e-7, -1e-9, -5e-324, -0.0, 0.0, 5e-324, *np.geomspace(1e-12, 1e-4, 400), 1.0, np.nextafter(2.0, 1), 2.0]
    values += [*np.linspace(990.0, 1040.0, 400), 3e300]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double").coalesce(1)
    for bits, least in zip(quantiles.BIN_BITS, (400, 800)):
        bins = [r.b for r in df.select("i", quantiles.order_bin(df.v, bits).alias("b")).sort("i").collect()]
        assert bins == sorted(bins) and len(set(bins)) > least
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = quantiles.exact_quantiles(df, [], "v", probs, list("abcde")).first()
    assert np.allclose(list(got), np.quantile(values, probs), rtol=1e-12)


@pytest.mark.parametrize("empty", ["null", "zero"])
def test_quantiles_and_tails_over_neighbours(spark, empty):
    """Against plain lists; half of the rows in one group, equal values in several groups, signs, a null key."""
    r = np.random.default_rng(7)
    groups = [*r.integers(0, 4, 300).tolist(), *[2] * 300]
    rows = [(float(g), ("x", None)[i % 5 == 0], float(r.choice([0.0, 0.1, 0.1 + 1e-9, -3.5, r.normal() * 50]))) for i, g in enumerate(groups)]
    df = spark.createDataFrame(rows, "g double, k string, v double")
    to_next = lambda d: stats.neighbour_fanout(d, {"g": 1.0})
    probs, names = [0.95, 0.75, 0.5, 0.0], list("abcd")
    held = {}
    for g, k, v in rows:
        for shift in (-1.0, 0.0, 1.0):
            held.setdefault((g + shift, k), []).append(v)
    got = {(x.g, x.k): [x[c] for c in names] for x in quantiles.exact_quantiles(df, ["g", "k"], "v", probs, names, to_next).collect()}
    assert got.keys() == held.keys() and len(got) == 12
    for key, values in held.items():
        assert np.allclose(got[key], np.quantile(values, probs), rtol=1e-12, atol=1e-15)
    tails = quantiles.tail_means(df, ["g", "k"], "v", probs, names, empty, to_next)
    for x in tails.collect():
        values = np.array(held[x.g, x.k])
        for c, q in zip(names, got[x.g, x.k]):
            above = values[values > q]
            want = above.sum() / len(values) if empty == "zero" else above.mean() if len(above) else None
            assert x[c] == (None if want is None else pytest.approx(want, rel=1e-9, abs=1e-12))


def test_global_quantile_and_extremes(spark):
    rows = [(float(i), i) for i in range(101)]
    df = spark.createDataFrame(rows, "Sum_Precip double, id int")
    assert sorted(r.id for r in stats.extreme_events(df).collect()) == list(range(96, 101))


def test_box_stats(spark):
    v = [1.0, 2.0, 3.0, 4.0, 5.0, 40.0]
    r = quantiles.box_stats(spark.createDataFrame([("a", x) for x in v], "k string, v double"), ["k"], "v").first()
    assert (r.q1, r.median, r.q3) == (2.25, 3.5, 4.75)
    assert (r.whisker_low, r.whisker_high, r.n, r.outliers) == (1.0, 5.0, 6, 1)


def test_normal_quantile_and_gamma():
    p = np.concatenate([np.logspace(-200, -1, 300), np.linspace(0.001, 0.999, 501)])
    want = np.array([NormalDist().inv_cdf(v) for v in p])
    assert np.abs(numerics.normal_quantile(p) - want).max() < 1e-12
    x = np.linspace(0.01, 30, 200)
    assert np.allclose(numerics.gamma_cdf(np.ones(200), x), 1 - np.exp(-x), atol=1e-14)
    assert np.allclose(numerics.gamma_cdf(np.full(200, 0.5), x), [math.erf(math.sqrt(v)) for v in x], atol=1e-14)
    assert np.allclose(
        numerics.gamma_cdf(np.full(200, 3.0), x) + numerics.gamma_cdf(np.full(200, 3.0), x, upper=True), 1.0
    )


@pytest.fixture(scope="module")
def daily(spark):
    rng = random.Random(5)
    rows = []
    for s in ("a", "b"):
        for i in range(5 * 365):
            if s == "b" and 400 <= i < 410:
                continue
            rain = rng.gammavariate(0.6, 8) if rng.random() < 0.3 else 0.0
            rows.append((s, (datetime(2000, 1, 1) + timedelta(days=i)).date(), rain, rng.random(), rng.random()))
    ddl = "Location string, Time_SPI date, Day_rain double, Day_Pressure_chng_av double, Temp_dew_diff double"
    return stage(spark.createDataFrame(rows, ddl), "daily")


@pytest.mark.parametrize("block", [40, 2048])
def test_rolling_rain(daily, block):
    got = drought.rolling_rain(daily, 30, block).toPandas().sort_values(["Location", "Time_SPI"])
    p = daily.toPandas().sort_values(["Location", "Time_SPI"])
    want = []
    for s, g in p.groupby("Location"):
        own = g.set_index(pd.to_datetime(g.Time_SPI)).Day_rain
        want += list(own.asfreq("D").rolling(30, min_periods=30).sum().reindex(own.index))
    assert len(want) == len(got) == len(p)
    assert np.allclose(got.rain_sum.astype(float), want, equal_nan=True)


def test_rolling_rain_keeps_days_without_rain_value(daily):
    unknown = F.date_format("Time_SPI", "MM-dd") == "03-01"
    some = daily.withColumn("Day_rain", F.when(~unknown, F.col("Day_rain")))
    got = drought.rolling_rain(some).toPandas()
    assert len(got) == daily.count()
    t = pd.to_datetime(got.Time_SPI)
    assert got.rain_sum[(t.dt.month == 3) & (t.dt.day < 31)].isna().all()
    assert got.rain_sum[(t.dt.year > 2000) & (t.dt.month == 4) & (got.Location == "a")].notna().all()
    spi = drought.spi_daily(some).toPandas()
    assert len(spi) == len(got) and spi.value[spi.rain_sum.isna()].isna().all() and spi.value.notna().any()


@pytest.mark.parametrize("pooled", [False, True])
def test_spi(daily, pooled):
    got = drought.spi_daily(daily, pooled=pooled).toPandas()
    assert len(got) == daily.count()
    roll = drought.rolling_rain(daily).toPandas().dropna(subset=["rain_sum"])
    roll["doy"] = pd.to_datetime(roll.Time_SPI).dt.dayofyear
    keys = ["doy"] if pooled else ["Location", "doy"]
    checked = 0
    both = got.merge(roll, left_on=["Location", "time_stamp"], right_on=["Location", "Time_SPI"])
    for _, g in list(both.groupby(keys))[:40]:
        x = g.rain_sum_x.to_numpy()
        wet = x[x > 0]
        a = math.log(wet.mean()) - np.log(wet).mean()
        if a <= 1e-9:
            continue
        shape = (1 + math.sqrt(1 + 4 * a / 3)) / (4 * a)
        cdf = numerics.gamma_cdf(np.full(len(x), shape), x / (wet.mean() / shape))
        q = (x == 0).mean()
        want = numerics.normal_quantile(q + (1 - q) * cdf)
        assert np.allclose(g.value.astype(float), want, atol=1e-8)
        checked += 1
    assert checked > 20
    assert abs(got.value.mean()) < 0.15


def test_weekly_and_monthly_spi(daily):
    spi = drought.spi_daily(daily, years=(2002, 2003))
    joined = drought.join_spi_daily(spi, daily)
    p = joined.toPandas()
    p["t"] = pd.to_datetime(p.time_stamp)
    weeks = drought.weekly_spi(joined).toPandas()
    want = p.groupby(["Location", p.t.dt.year, p.t.dt.month, (p.t.dt.dayofyear - 1) // 7 + 1]).Temp_dew_diff.sum()
    assert len(weeks) == len(want)
    assert weeks.diff_T_D.sum() == pytest.approx(want.sum())
    assert (weeks.dew_band % 40 == 0).all()
    months = drought.monthly_spi(joined).toPandas()
    assert len(months) == 2 * 24


def test_weekly_sums_follow_missing_values(spark):
    n = 14 * 24
    s = series(
        spark, ["a"], Temp_C=[20.0] * n, DewPt_C=[10.0] * n, RH=[50.0] * n,
        Rain=[1.0] * n, pressure_chng_av=[None] + [0.5] * (n - 1), CMI=[None] * (n - 1) + [3.0], CMI_pre=[None] * n,
    ).withColumn("Press_Evt_lab", F.when(F.dayofmonth("Time") <= 7, 1).otherwise((F.dayofmonth("Time") / 2).cast("int")).cast("long"))
    w = {r.Wk: r for r in drought.weekly_cmi(s).collect()}
    assert w[1].PCE_num == 0 and w[1].cum_Temp == float("inf") and w[1].cum_Pressure_chng is None
    assert w[2].PCE_num == 3 and w[2].cum_Temp == pytest.approx(20 * 168 / 3) and w[2].CMI == 3.0
    assert w[2].wk_Rain == 168 and w[2].cum_Pressure_chng == 84.0
    rows = drought.weekly_pce_count(s)
    assert rows.count() == n and rows.where("Wk = 2").first().year_wk == "2020 2"
    assert drought.weekly_extract(rows).count() == 2


def test_cmi_shift_modes(spark):
    r = spark.createDataFrame([("a", datetime(2020, 1, d, 0, 10), 1.0) for d in (6, 13, 20, 27)], "Location string, Time timestamp, x double")
    cmi = spark.createDataFrame(
        [("a", datetime(2020, 1, d), float(d)) for d in (6, 13, 20, 27)] + [("a", datetime(2020, 2, 3), 34.0)],
        "location string, ymd_hms timestamp, CMI double",
    )
    same = {x.Time.day: x.CMI for x in drought.join_cmi(r, cmi).collect()}
    assert same == {6: 6.0, 13: 13.0, 20: 20.0, 27: 27.0}
    before = {x.Time.day: x.CMI_pre for x in drought.join_cmi_shift(r, cmi).collect()}
    assert before == {6: None, 13: 6.0, 20: 13.0, 27: 20.0}
    later = {x.Time.day: x.CMI_pre for x in drought.join_cmi_shift(r, cmi, "day_of_month").collect()}
    assert later == {6: 13.0, 13: 20.0, 20: 27.0, 27: None}


def bell(u):
    return np.exp(-0.5 * u * u) / math.sqrt(2 * math.pi)


def test_densities_near_direct_sums(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(0, 3, 800), rng.gamma(2, 2, 800)
    df = stage(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), "xy")

    def width(v, f):
        return f * min(v.std(ddof=1), (np.quantile(v, 0.75) - np.quantile(v, 0.25)) / 1.34) * len(v) ** -0.2

    h = width(x, 0.9)
    got = fit.kde_1d(df, "x", 100).toPandas().sort_values("i")
    assert got.x.iloc[0] == pytest.approx(x.min() - 3 * h) and got.x.iloc[-1] == pytest.approx(x.max() + 3 * h)
    want = bell((got.x.to_numpy()[:, None] - x) / h).sum(axis=1) / (len(x) * h)
    assert np.abs(got.density - want).max() < 1e-4
    assert np.trapezoid(got.density, got.x) == pytest.approx(1, abs=2e-3)
    hx, hy = width(x, 1.06), width(y, 1.06)
    two = fit.kde_2d(df, "x", "y", 12).toPandas()
    want = [(bell((a - x) / hx) * bell((b - y) / hy)).sum() / (len(x) * hx * hy) for a, b in zip(two.x, two.y)]
    assert np.abs(two.density - want).max() < 1e-4


def test_densities_of_skewed_and_constant_data(spark):
    rng = np.random.default_rng(8)
    x = np.append(rng.exponential(1, 3000) ** 3, 1e6)
    df = stage(spark.createDataFrame(pd.DataFrame({"x": x, "y": -x})), "skewed")
    h = min(x.std(ddof=1), (np.quantile(x, 0.75) - np.quantile(x, 0.25)) / 1.34) * len(x) ** -0.2
    got = fit.kde_1d(df, "x", 50).toPandas()
    want = bell((got.x.to_numpy()[:, None] - x) / (0.9 * h)).sum(axis=1) / (len(x) * 0.9 * h)
    assert len(got) == 50 and np.abs(got.density - want).max() < 1e-4 * want.max()
    two = fit.kde_2d(df, "x", "y", 6).toPandas()
    want = [(bell((a - x) / (1.06 * h)) * bell((b + x) / (1.06 * h))).sum() / (len(x) * (1.06 * h) ** 2) for a, b in zip(two.x, two.y)]
    assert len(two) == 36 and np.abs(two.density - want).max() < 1e-4 * max(want)
    for values in ([2.0], [2.0] * 5, [0.0, 0.0]):
        same = spark.createDataFrame([(v, v) for v in values], "x double, y double")
        assert fit.kde_1d(same, "x", 8).where("density > 0").count() == 8
        assert fit.kde_2d(same, "x", "y", 3).where("density > 0").count() == 9


@pytest.mark.parametrize("degree", [1, 2])
def test_local_regression_matches_brute_force(spark, degree):
    rng = np.random.default_rng(4)
    n = 400
    p = pd.DataFrame({"MonT": rng.normal(15, 8, n), "Sum_Press_Delta": rng.normal(0, 20, n)})
    p["RainProb"] = rng.random(n) + 0.01 * p.MonT
    axes = [(0.0, 30.0, 10.0), (-40.0, 40.0, 20.0)]
    grid = fit.grid_points(axes)
    names = ["MonT", "Sum_Press_Delta"]
    got = fit.local_regression(stage(spark.createDataFrame(p), "pts"), names, "RainProb", grid, 0.7, degree).toPandas()
    assert len(got) == len(grid)
    x, y = p[names].to_numpy(), p.RainProb.to_numpy()
    for r in got.itertuples():
        d = np.sqrt(((x - [r.MonT, r.Sum_Press_Delta]) ** 2).sum(axis=1))
        w = np.sqrt(np.clip(1 - (d / np.sort(d)[int(0.7 * n) - 1]) ** 3, 0, None) ** 3)
        u = (x - [r.MonT, r.Sum_Press_Delta]) / [8, 20]
        b = [np.ones(n), u[:, 0], u[:, 1]] + ([u[:, 0] ** 2, u[:, 0] * u[:, 1], u[:, 1] ** 2] if degree == 2 else [])
        want = np.linalg.lstsq(np.stack(b, 1) * w[:, None], y * w, rcond=None)[0][0]
        assert r.fit == pytest.approx(want, abs=1e-7)
    rows = {(r.MonT, r.Sum_Press_Delta) for r in fit.grid_frame(spark, axes, names).collect()}
    assert rows == {tuple(v) for v in grid}


def test_local_curve_reproduces_a_parabola(spark):
    df = spark.createDataFrame([(float(i), 1.0 + 2 * i - 0.5 * i * i) for i in range(30)], "x double, y double")
    got = fit.local_curve(df, "x", "y").toPandas()
    assert len(got) == 80 and np.allclose(got.fit, 1 + 2 * got.x - 0.5 * got.x**2, atol=1e-7)


def test_pop_counts_missing_as_dry(spark):
    ev = spark.createDataFrame(
        [(9.0, 1), (-9.0, 0), (8.0, None), (30.0, 2)], "Sum_Press_Delta double, St_Rain long"
    )
    got = {r.Evt_Press_chng: (r.RainProb, r.samplesize) for r in stats.pop_by_epc(ev).collect()}
    assert got[0.0] == (pytest.approx(1 / 3), 3) and got[40.0] == (1.0, 1)


def test_case_study_is_closed(spark):
    s = series(spark, ["a", "b"], x=[1.0] * 10)
    got = stats.case_study(s, "b", str(T0 + timedelta(hours=2)), str(T0 + timedelta(hours=5)))
    assert got.count() == 4
