"""Hand-worked expectations, one per rule."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from baroflow.functions import ceil_cut, epc_band, floor_step, month_season, round_step, week_of_year
from baroflow.functions.dates import monday_of_week
from baroflow.operators import events, grid, labels, quantiles, smooth, stats
from baroflow.sources import parse_cmi_lines, station_records
from tests.helpers import T0, column, readings, series

F1 = [0, 0, 0, 0, 0, 0, 2, 0, 1, 0, 0, 0, 0, 3, 0, 0, 0, 0, 0, 0, 0, 4, 0, 0, 0, 0, 0, 0, 0]
F2 = [0, 1, 1, 0, 0, 0, 0, 0, 0, 0, 2, 2, 0, 0]


def runs(*pairs):
    return [v for v, n in pairs for _ in range(n)]


@pytest.mark.parametrize(
    "rain, rule, expected",
    [
        (F1, "A", runs((0, 6), (1, 8), (2, 7), (3, 1), (4, 7))),
        (F1, "B", runs((0, 6), (1, 3), (2, 4), (3, 1), (4, 7), (5, 1), (6, 7))),
        (F2, "A", [0, 1, 2, 3, 3, 3, 3, 3, 3, 3, 4, 4, 4, 4]),
        (F2, "B", [0, 0, 0, 1, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2]),
    ],
)
@pytest.mark.parametrize("block", [7, 2048])
def test_rain_labels(spark, rain, rule, expected, block):
    s = series(spark, ["a"], Rain=[float(x) for x in rain])
    assert column(labels.label_rain_dry(s, rule=rule, block_steps=block), "Evt_lab") == expected


@pytest.mark.parametrize("block", [3, 2048])
def test_pressure_labels(spark, block):
    chng = [None, None, 1.0, 2.0, -1.0, -0.5, 0.0, 0.0, 3.0, -2.0, -2.0, None]
    s = series(spark, ["a"], pressure_chng_av=chng)
    out = labels.label_pressure_events(s, block_steps=block)
    assert column(out, "Press_Evt_lab") == [0, 0, 0, 0, 1, 1, 2, 2, 2, 3, 3, 3]


@pytest.mark.parametrize("block", [50, 2048])
def test_smoothing(spark, block):
    s = series(spark, ["a"], pressure_spl=[float(i) for i in range(1, 49)])
    out = smooth.pressure_change(s, block_steps=block)
    av, chng = column(out, "pressure_av"), column(out, "pressure_chng_av")
    assert [i for i, v in enumerate(av) if v is not None] == list(range(11, 36))
    assert av[11] == 12.5
    assert [(i, v) for i, v in enumerate(chng) if v is not None] == [(35, 24.0)]


@pytest.mark.parametrize("n", [1, 5, 6, 7, 24])
def test_mean_width(spark, n):
    values = [float((i * 37) % 11) for i in range(40)]
    out = column(smooth.rolling_means(series(spark, ["a"], x=values), {"x": "m"}, n), "m")
    before, after = smooth.mean_span(n)
    for i, got in enumerate(out):
        if i - before < 0 or i + after >= 40:
            assert got is None
        else:
            assert got == pytest.approx(sum(values[i - before : i + after + 1]) / n)


@pytest.mark.parametrize("method, expected", [("spline", 27.0), ("linear", 36.0)])
def test_fill(spark, method, expected):
    rows = [("a", T0 + timedelta(hours=t), {"Pressure_hPa": float(t**3)}) for t in (0, 1, 2, 4, 5)]
    filled = smooth.fill_and_pad(grid.bucket_mean(readings(spark, rows)), method)
    assert column(filled, "pressure_spl")[3] == pytest.approx(expected)


def test_gap_overlap(spark):
    day = lambda h, m=0: datetime(2020, 1, 1, h, m)
    ev = spark.createDataFrame(
        [("a", 1, day(10), day(14)), ("a", 2, day(15), day(18))],
        "Location string, Press_Evt_lab long, St timestamp, End timestamp",
    )
    for end, hit in ((day(14, 30), {1}), (day(15), {1, 2})):
        gap = spark.createDataFrame([("a", day(14), end, 1.0)], "Location string, St timestamp, End timestamp, TimeLag_min double")
        for width in (1, 3, 720):
            got = events.overlap_join(gap, ev, bucket_steps=width).collect()
            assert sorted(r.Press_Evt_lab for r in got) == sorted(hit)


def test_quantiles_and_tails(spark):
    df = spark.createDataFrame([("x", v) for v in (1.0, 2.0, 10.0, 20.0)] + [("y", 7.0)], "k string, v double")
    names = ["a", "b", "c"]
    q = {r.k: (r.a, r.b, r.c) for r in quantiles.exact_quantiles(df, ["k"], "v", stats.PROBS, names).collect()}
    assert q["x"] == pytest.approx((18.5, 12.5, 6.0)) and q["y"] == (7.0, 7.0, 7.0)
    null = {r.k: (r.a, r.b, r.c) for r in quantiles.tail_means(df, ["k"], "v", stats.PROBS, names).collect()}
    assert null == {"x": (20.0, 20.0, 15.0), "y": (None, None, None)}
    zero = {r.k: (r.a, r.b, r.c) for r in quantiles.tail_means(df, ["k"], "v", stats.PROBS, names, "zero").collect()}
    assert zero == {"x": (5.0, 5.0, 7.5), "y": (0.0, 0.0, 0.0)}


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def test_bins(spark):
    for x, want in ((30, 40), (10, 0), (-30, -40), (-10, 0)):
        got = one(spark, round_step(F.lit(float(x)), 20))
        assert got == want and str(got) != "-0.0"
    assert one(spark, floor_step(F.lit(-31.0), 30)) == -60 and one(spark, floor_step(F.lit(30.0), 30)) == 30
    assert one(spark, epc_band(F.lit(-300.0))) == "-2000 hPa ~ -300 hPa"
    assert one(spark, epc_band(F.lit(0.0))) == "-300 hPa ~ 0 hPa"
    assert one(spark, epc_band(F.lit(-2000.0))) is None
    assert one(spark, ceil_cut(F.lit(1e9), [0, 1, float("inf")], ["a", "b"])) == "b"
    seasons = [one(spark, month_season(F.lit(m))).split()[0] for m in (2, 3, 5, 6, 8, 9, 11, 12)]
    assert seasons == ["Winter", "Spring", "Spring", "Summer", "Summer", "Fall", "Fall", "Winter"]


@pytest.mark.parametrize("day, week", [("2021-01-01", 1), ("2021-01-07", 1), ("2021-01-08", 2), ("2021-12-31", 53)])
def test_week(spark, day, week):
    assert one(spark, week_of_year(F.to_date(F.lit(day)))) == week


def test_monday_matches_strptime(spark):
    cases = [(y, w) for y in range(1973, 2019) for w in (0, 1, 2, 26, 52)]
    df = spark.createDataFrame(cases, "y int, w int").select("y", "w", monday_of_week("y", "w").alias("d"))
    for r in df.collect():
        assert r.d == datetime.strptime(f"{r.y}{r.w:02d}-1", "%Y%W-%w").date(), (r.y, r.w)


def test_fanout(spark):
    df = spark.createDataFrame([(20.0, 60.0, "dry", 1.0)], "MonT double, Sum_Press_Delta double, Season string, Sum_Precip double")
    got = {(r.MonT, r.Sum_Press_Delta) for r in stats.neighbour_fanout(df, stats.FANOUT).collect()}
    assert got == {(a, e) for a in (19.0, 20.0, 21.0) for e in (30.0, 60.0, 90.0)}


CMI = [
    (2, "80197 1 0.55 0.1.  3.10 0.20 -1.25 0.80 0.90 2.00", "8019701", "-1.25", ("801", "1997-01-06")),
    (2, "802201252 0.10 7.  3.10 0.20 0.35 0.80 0.90 2.00", "802201252", "0.35", ("802", "2012-12-24")),
    (1, "80373 5 1.10 0.2.  3.10 0.20 2.50 0.80 0.90 2.00", "8037305", "2.50", ("803", "1973-01-29")),
    (1, "8037312 1.10.  3.10 0.20 -0.40 0.80 0.90 2.00", "8037312", "-0.40", ("803", "1973-03-19")),
    (2, "801199753 0.10 7.  3.10 0.20 0.35 0.80 0.90 2.00", "801199753", "0.35", None),
    (2, "4401199752 0.10 7.  3.10 0.20 0.35 0.80 0.90 2.00", "4401199752", "0.35", None),
]


def test_cmi_lines(spark):
    from baroflow.sources.cmi_text import DISTRICTS

    lines = spark.createDataFrame([(a, f"  {b}\t") for a, b, *_ in CMI], "layout int, value string")
    parsed = parse_cmi_lines(lines)
    assert sorted((r.id, r.CMI) for r in parsed.collect()) == sorted((i, c) for _, _, i, c, _ in CMI)
    got = sorted((r.location, r.ymd_hms, r.CMI) for r in station_records(parsed).collect())
    want = sorted((DISTRICTS[w[0]], f"{w[1]} 00:00:00", c) for _, _, _, c, w in CMI if w)
    assert got == want


def test_unknown_district_is_an_error(spark):
    lines = spark.createDataFrame([(1, "8097312 1.10.  3.10 0.20 -0.40 0.80 0.90 2.00")], "layout int, value string")
    with pytest.raises(Exception, match="unknown district"):
        station_records(parse_cmi_lines(lines)).collect()
