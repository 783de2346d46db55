"""Properties of the whole chain, and equality of the blockwise operators with plain ones."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from baroflow.functions import numerics
from baroflow.operators import blocks, drought, events, grid, labels, smooth
from baroflow.plans.curation import Curated, Settings
from baroflow.plans.staging import stage
from tests.helpers import column, random_readings, series


@pytest.fixture(scope="module")
def data(spark):
    return stage(random_readings(spark), "readings")


@pytest.fixture(scope="module")
def curated(data):
    return Curated(data, Settings(block_steps=128))


def frame(df, *order):
    p = df.toPandas()
    return p.sort_values(list(order)).reset_index(drop=True)[sorted(p.columns)]


def test_grid_is_complete(curated):
    s = frame(curated.labelled, "Location", "step")
    for _, g in s.groupby("Location"):
        assert (np.diff(g.step) == 1).all()
    first = curated.buckets.groupBy("Location").agg(F.min("step").alias("a"), F.max("step").alias("b")).collect()
    for r in first:
        g = s[s.Location == r.Location]
        assert (g.step.min(), g.step.max()) == (r.a, r.b)


def test_labels_rise_by_at_most_one(curated):
    s = frame(curated.labelled, "Location", "step")
    for _, g in s.groupby("Location"):
        for c in ("Evt_lab", "Press_Evt_lab"):
            assert g[c].iloc[0] >= 0 and set(np.diff(g[c])) <= {0, 1}
        assert (g.StR + g.StD <= 1).all()


def test_fill_keeps_known_points(curated):
    s = frame(curated.labelled, "Location", "step")
    known = s[s.Pressure_hPa.notna()]
    assert (known.Pressure_hPa == known.pressure_spl).all()
    assert s.pressure_spl.notna().all()


def test_events_partition_the_series(curated):
    s = frame(curated.labelled, "Location", "step")
    e = frame(curated.events_before_gaps, "Location", "Press_Evt_lab")
    assert len(e) > 20
    inner = s[(s.Press_Evt_lab > 0) & (s.Press_Evt_lab < s.groupby("Location").Press_Evt_lab.transform("max"))]
    assert e.Dur.sum() == len(inner)
    assert e.Sum_Precip.sum() == pytest.approx(inner.Rain.sum())
    assert e.Sum_Precip.sum() <= s.Rain.sum()


def test_no_event_overlaps_a_gap(curated):
    e, g = curated.events.toPandas(), curated.gaps.toPandas()
    assert len(e) and len(g)
    both = e.merge(g, on="Location", suffixes=("", "_gap"))
    assert not ((both.St_gap <= both.End) & (both.End_gap >= both.St)).any()


def test_two_passes_agree(curated):
    """Events taken from parts equal events recomputed on the gap-free rows."""
    direct = events.pressure_events(events.event_parts(curated.gap_free_series))
    pd.testing.assert_frame_equal(
        frame(curated.events, "Location", "Press_Evt_lab"), frame(direct, "Location", "Press_Evt_lab")
    )


def test_spells_and_gap_free_rows_from_block_labels(curated):
    """Offsets added to aggregates give the same events and rows as offsets added to the series."""
    key = ["Location", "Evt_lab"]
    for of_parts, direct in ((events.rain_spells, events.rain_events), (events.dry_spells, events.dry_events)):
        pd.testing.assert_frame_equal(frame(of_parts(curated.spells), *key), frame(direct(curated.labelled), *key))
    removed = events.remove_gap_events(curated.labelled, curated.overlapped, curated.parts)
    pd.testing.assert_frame_equal(
        frame(curated.gap_free_series, "Location", "step"), frame(removed, "Location", "step")
    )


def series_scans(df):
    """Scans of the labelled series, and joins above any of them before an aggregate, in the static plan."""
    tree = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-|!"))
    scans, joins = 0, 0
    for at, line in enumerate(tree):
        if not ("Relation" in line and "pressure_chng_av" in line):
            continue
        scans, level = scans + 1, depth(line)
        for above in reversed(tree[:at]):
            if depth(above) < level:
                level = depth(above)
                if "Aggregate" in above:
                    break
                joins += above.lstrip(" :+-|").startswith("Join")
    return scans, joins


def test_readers_of_the_series_do_not_join_it(curated):
    """Without a label to complete, and for spells, the series meets an aggregate before any join."""
    assert series_scans(drought.daily_agg(curated.series)) == (1, 0)
    assert series_scans(events.monthly_temp(curated.series)) == (1, 0)
    assert series_scans(curated.spells) == (1, 0)
    assert series_scans(curated.gap_free_series) == (1, 1)
    assert series_scans(curated.labelled) == (1, 1)


@pytest.mark.parametrize("block", [64, 200, 100000])
def test_block_size_does_not_matter(data, curated, block):
    other = Curated(data.repartition(7), replace(curated.settings, block_steps=block))
    cols = ["Location", "step", "pressure_chng_av", "StR", "StD", "Evt_lab", "Press_Evt_lab"]
    pd.testing.assert_frame_equal(
        frame(curated.labelled.select(cols), "Location", "step"), frame(other.labelled.select(cols), "Location", "step")
    )
    pd.testing.assert_frame_equal(
        frame(curated.gaps, "Location", "St"), frame(other.gaps, "Location", "St")
    )


def test_gaps_match_sorted_readings(data, curated):
    p = data.toPandas().sort_values(["Location", "Time"])
    lag = p.groupby("Location").Time.diff().dt.total_seconds() / 60
    assert curated.gaps.count() == int((lag >= 240).sum())


def test_recurrent_gaps(data):
    b = grid.bucket_mean(data)
    lags = grid.reading_lags(b).withColumn("TimeLag_min", F.floor(F.col("TimeLag_min") / 30) * 30.0)
    counts = {
        (r.Location, r.TimeLag_min): r["count"]
        for r in lags.where("TimeLag_min > 60 AND TimeLag_min < 240").groupBy("Location", "TimeLag_min").count().collect()
    }
    kept = grid.recurrent_lags(lags, 60, 240, 5).groupBy("Location", "TimeLag_min").count().collect()
    assert {(r.Location, r.TimeLag_min): r["count"] for r in kept} == {k: n for k, n in counts.items() if n > 5}
    with pytest.raises(ValueError):
        grid.gap_table(b, gap_min=30)


def test_neighbour_rows_match_windows(spark):
    values = [None if i % 5 in (1, 2, 3) or 20 <= i < 60 else float(i) for i in range(100)]
    s = series(spark, ["a", "b"], x=values)
    known = F.col("x").isNotNull()
    got = blocks.neighbour_rows(
        s,
        previous={"p": (F.col("x"), known), "q": (F.col("x"), known)},
        following={"n": (F.col("x"), known), "r": (F.col("step"), None)},
        size=8,
        inclusive=("q",),
    )
    w = Window.partitionBy("Location").orderBy("step")
    back, fwd = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    want = s.select(
        "Location", "step", "x",
        F.last("x", True).over(back).alias("p"),
        F.last("x", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("q"),
        F.first("x", True).over(fwd).alias("n"),
        F.lead("step").over(w).alias("r"),
    )
    cols = ["Location", "step", "x", "p", "q", "n", "r"]
    assert sorted(map(tuple, got.select(cols).collect()), key=str) == sorted(map(tuple, want.select(cols).collect()), key=str)


def test_explode_range(spark):
    df = spark.createDataFrame([(1, 0, 9999), (2, 5, 5), (3, 7, 6)], "k int, a long, b long")
    got = blocks.explode_range(df, F.col("a"), F.col("b"), "i").groupBy("k").agg(F.count("*"), F.sum("i")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 10000, sum(range(10000))), (2, 1, 5)]


def dense_spline(x, y, at):
    n, h, s = len(x), np.diff(x), np.diff(y) / np.diff(x)
    m, r = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        m[i, i - 1], m[i, i], m[i, i + 1], r[i] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i], s[i] - s[i - 1]
    third = np.diff(np.diff(s) / (x[2:] - x[:-2])) / (x[3:] - x[:-3])
    m[0, 0], m[0, 1], r[0] = -h[0], h[0], h[0] ** 2 * third[0]
    m[-1, -1], m[-1, -2], r[-1] = -h[-1], h[-1], -(h[-1] ** 2) * third[-1]
    c = np.linalg.solve(m, r)
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    a, b = (x[i + 1] - at) / h[i], (at - x[i]) / h[i]
    return a * y[i] + b * y[i + 1] + ((a**3 - a) * c[i] + (b**3 - b) * c[i + 1]) * h[i] ** 2


def test_chunked_spline_equals_dense_solve(curated):
    src = curated.buckets.where("Pressure_hPa is not null").select("Location", "step", F.col("Pressure_hPa").alias("y"))
    got = frame(smooth.spline_coefficients(src, chunk=50, halo=64, all_knots=True), "Location", "step")
    for loc, k in frame(src, "Location", "step").groupby("Location"):
        b, c, d = numerics.cubic_coefficients(k.step.to_numpy(float), k.y.to_numpy())
        g = got[got.Location == loc]
        for name, v in (("_b", b), ("_c", c), ("_d", d)):
            assert np.allclose(g[name], v, rtol=0, atol=1e-11)
    full = frame(curated.labelled, "Location", "step")
    for loc, g in full.groupby("Location"):
        k = g[g.Pressure_hPa.notna()]
        want = dense_spline(k.step.to_numpy(float), k.Pressure_hPa.to_numpy(), g.step.to_numpy(float))
        assert np.abs(want - g.pressure_spl.to_numpy()).max() < 1e-9


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_spline_with_few_points(n):
    x, y = np.arange(n, dtype=float) * 2, np.array([1.0, 4.0, 2.0, 7.0])[:n]
    b, c, d = numerics.cubic_coefficients(x, y)
    if n == 1:
        assert np.isnan(b).all()
        return
    for i in range(n - 1):
        t = x[i + 1] - x[i]
        assert y[i] + t * (b[i] + t * (c[i] + t * d[i])) == pytest.approx(y[i + 1])
    if n == 3:
        assert np.allclose(d, 0)


def test_harmonic_fill(spark):
    temp = [20 + 5 * np.sin(2 * np.pi * i / 24) for i in range(24 * 10)]
    holes = [float(v) if not (100 <= i < 112 or i == 150) else None for i, v in enumerate(temp)]
    out = smooth.harmonic_fill(series(spark, ["a"], Temp_C=holes), block_steps=64)
    cure = column(out, "temp_cure")
    for i, v in enumerate(cure):
        if 99 <= i <= 112 or 149 <= i <= 151:
            assert v == pytest.approx(temp[i], abs=1e-6)
        else:
            assert v is None
    fixed = column(smooth.harmonic_fill(series(spark, ["a"], Temp_C=holes), base=24.5, block_steps=64), "temp_cure")
    assert fixed[105] - fixed[104] == pytest.approx(cure[105] - cure[104])


def test_harmonic_fill_at_the_start_of_a_series(spark):
    temp = [20 + 5 * np.sin(2 * np.pi * i / 24) for i in range(24 * 10)]
    holes = [float(v) if i >= 30 else None for i, v in enumerate(temp)]
    data = series(spark, ["a", "b"], Temp_C=holes)
    assert column(smooth.harmonic_fill(data, block_steps=16), "temp_cure")[:30] == [None] * 30
    # From the step before the series on, the profile adds up to the change since then.
    cure = column(smooth.harmonic_fill(data, base=24.5, block_steps=16), "temp_cure")
    before = 20 + 5 * np.sin(2 * np.pi * -1 / 24)
    for i in range(30):
        assert [cure[i], cure[240 + i]] == pytest.approx([24.5 + temp[i] - before] * 2, abs=1e-6)
    assert cure[30] == holes[30] and cure[31] is None


def test_harmonic_profile_period(spark):
    temp = [20 + 3 * np.cos(2 * np.pi * i / 12) for i in range(24 * 10)]
    holes = [float(v) if not 50 <= i < 58 else None for i, v in enumerate(temp)]
    data = series(spark, ["a"], Temp_C=holes)
    cure = column(smooth.harmonic_fill(data, period=12.0), "temp_cure")
    assert cure[50:58] == pytest.approx(temp[50:58], abs=1e-6)
    with pytest.raises(ValueError, match="multiple"):
        smooth.harmonic_fill(data, period=7.0)


def test_several_columns_are_filled_as_each_alone(data):
    b = stage(grid.bucket_mean(data), "buckets")
    names = {"Pressure_hPa": "p", "Temp_C": "t", "RH": "r"}
    together = frame(smooth.fill_and_pad(b, "spline", columns=names, block_steps=128), "Location", "step")
    for c, out in names.items():
        alone = frame(smooth.fill_and_pad(b, "spline", columns={c: out}, block_steps=128), "Location", "step")
        assert np.allclose(together[out], alone[out], rtol=0, atol=1e-9, equal_nan=True)


def test_rule_and_method_are_checked(spark, data):
    with pytest.raises(ValueError):
        smooth.fill_and_pad(grid.bucket_mean(data), "nearest")
    with pytest.raises(ValueError):
        labels.label_rain_dry(series(spark, ["a"], Rain=[0.0]), rule="C")
