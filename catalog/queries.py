"""One query per operator, over whole tables."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from baroflow import sources
from baroflow.functions import (
    as_double,
    epc_band,
    floor_step,
    half_year,
    log_step,
    month_season,
    pce_type,
    round_step,
    snap,
    week_of_year,
    wet_dry,
)
from baroflow.functions.bins import EPC_EDGES_500
from baroflow.functions.dates import monday_of_week
from baroflow.operators import curves, drought, events, fit, grid, labels, quantiles, smooth, stats
from baroflow.operators.blocks import explode_range
from baroflow.plans.curation import DAILY, DAILY_RECURRENT, Curated, Settings
from baroflow.plans import entries
from baroflow.plans.entries import with_cmi
from baroflow.plans.staging import shared_folder, stage
from baroflow.plans.views import cmi_values, daily_readings, hourly_readings, table
from baroflow.schema import MEASURES, STATION, TIME
from baroflow.sources import cmi_text, isd_text, station_csv
from baroflow.sources.isd_text import drop_suffixes

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = lambda spark, sf_dir: tidy(fn(spark, sf_dir))
    return fn


def tidy(df: DataFrame) -> DataFrame:
    """Six decimals for doubles and zone-free timestamps, for comparison by value.

    Rounding to nine places first keeps summation noise from tipping a tie at the seventh.
    """
    cols = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = snap(snap(c), 6)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        cols.append(c.alias(f.name))
    return df.select(*cols)


# -- curated tables, computed once per session and input ---------------------------------

HOURLY = Settings()
_curated: dict = {}


def _once(spark: SparkSession, sf_dir: str, view: str, build):
    key = (spark.sparkContext.applicationId, sf_dir, view)
    if key not in _curated:
        _curated[key] = build()
    return _curated[key]


def hourly(spark, sf_dir, fill="linear") -> Curated:
    return _once(
        spark, sf_dir, f"hourly-{fill}",
        lambda: Curated(hourly_readings(spark, sf_dir), replace(HOURLY, fill=fill)),
    )


def daily(spark, sf_dir, fill="linear") -> Curated:
    return _once(
        spark, sf_dir, f"daily-{fill}",
        lambda: Curated(daily_readings(spark, sf_dir), replace(DAILY, fill=fill)),
    )


def daily_cmi(spark, sf_dir) -> Curated:
    return _once(
        spark, sf_dir, "daily-cmi",
        lambda: with_cmi(
            daily_readings(spark, sf_dir), cmi_values(spark, sf_dir), replace(DAILY, fill="linear"), "day_of_month"
        ),
    )


def daily_events(spark, sf_dir) -> DataFrame:
    return _once(spark, sf_dir, "daily-events", lambda: stage(daily(spark, sf_dir).events, "events"))


def weeks_of(spark, sf_dir) -> DataFrame:
    return _once(
        spark, sf_dir, "weeks",
        lambda: stage(drought.weekly_cmi(daily_cmi(spark, sf_dir).gap_free_series, *RANGE), "weeks"),
    )


RANGE = ("1992-01-01 00:00:00", "2001-12-31 23:59:59")
SERIES = [STATION, TIME, *MEASURES]


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# -- sources and sinks ----------------------------------------------------------------------


@query
def scan_station_csv(spark, sf):
    """Both source spellings: written out as CSV, read back by name, unioned."""
    folder = fresh_folder(spark, "station-csv")
    readings = hourly_readings(spark, sf)
    half = F.col(STATION).endswith("-0")
    sources.write_csv(readings.where(half).withColumnRenamed("Rain", station_csv.NCEI_RAIN), f"{folder}/a")
    sources.write_csv(readings.where(~half).withColumnRenamed("Rain", station_csv.FAWN_RAIN), f"{folder}/b")
    return sources.union_sources(
        sources.read_station_csv(spark, f"{folder}/a"),
        sources.read_station_csv(spark, f"{folder}/b", station_csv.FAWN_RAIN),
    )


def _isd_lines(spark, sf, date=None):
    """Raw station text made from ``events``, with sentinels and quality flags."""
    e = table(spark, sf, "events")
    v, i, u = F.col("value"), F.col("event_id"), F.col("user_id")
    usaf = F.element_at(F.array(*[F.lit(str(s[0])) for s in isd_text.STATIONS]), (u % 5 + 1).cast("int"))
    wban = F.element_at(F.array(*[F.lit(str(s[1])) for s in isd_text.STATIONS]), (u % 5 + 1).cast("int"))
    num = lambda c: (F.floor(c * 10) / 10).cast("string")
    empty = [F.lit("")] * 12
    fields = [
        usaf, wban, F.date_format("ts", "yyyyMMdd") if date is None else date, F.date_format("ts", "HHmm"), F.lit("4"), F.lit("FM-15"), F.lit("V02"),
        F.when(i % 17 == 0, F.lit("999.9")).otherwise(num(v % 35)), F.lit("1"),
        F.when(i % 19 == 0, F.lit("999.9")).otherwise(num(v % 20)), F.lit("1"),
        F.when(i % 13 == 0, F.lit("9999.9")).otherwise(num(v % 40 + 1000)), F.lit("1"),
        F.when(i % 3 == 0, F.lit("06")).otherwise(F.lit("01")), num(v % 9), F.lit(" "), (i % 8).cast("string"),
        *empty, F.when(i % 11 == 0, F.lit("999")).otherwise(num(v % 100)), F.lit(""),
    ]
    return e.select("event_id", F.concat_ws(",", *fields).alias("value"))


@query
def scan_isd_text(spark, sf):
    folder = fresh_folder(spark, "isd")
    _isd_lines(spark, sf).select("value").write.text(f"{folder}/a.txt")
    raw = sources.read_isd_text(spark, f"{folder}/*.txt")
    return sources.isd_readings(raw, sources.station_table(spark))


@query
def isd_rejects(spark, sf):
    """Broken data lines next to banner lines: files of up to 16,384 lines, two banners each."""
    folder = fresh_folder(spark, "isd-broken")
    date = F.when(F.col("event_id") % 29 == 0, F.date_format("ts", "yyyyMM")).otherwise(F.date_format("ts", "yyyyMMdd"))
    lines = _isd_lines(spark, sf, date).withColumn("part", F.floor(F.col("event_id") / (1 << 14))).withColumn("nr", F.lit(2))
    heads = F.array(*[F.struct(F.lit(i).alias("nr"), F.lit(t).alias("value")) for i, t in enumerate(["Station text", "USAF ,NCDC ,Date ,HrMn"])])
    banners = lines.select("part").distinct().select("part", F.inline(heads))
    both = lines.unionByName(banners, allowMissingColumns=True)
    both.repartition("part").sortWithinPartitions("part", "nr", "event_id").select("part", "value").write.partitionBy(
        "part"
    ).text(folder)
    fields = F.split("value", ",")
    bad = sources.isd_rejects(spark, folder)
    return bad.select(*[fields[i].alias(c) for i, c in enumerate(isd_text.FIELDS[:4])])


def _cmi_lines(spark, sf):
    """Index text lines, one for each of ``orders``: column ``layout`` and ``value``.

    Years before 1997 are written with two digits (layout 1), later ones with four (layout 2).
    """
    o = table(spark, sf, "orders")
    layout = F.when(F.year("o_orderdate") < 1997, F.lit(1)).otherwise(F.lit(2))
    district = F.when(F.col("o_custkey") % 9 == 0, F.lit("440")).otherwise(
        F.concat(F.lit("80"), (F.col("o_custkey") % 7 + 1).cast("string"))
    )
    year = F.year("o_orderdate").cast("string")
    week = (F.dayofyear("o_orderdate") - 1) % 54
    stem = F.concat(district, F.when(layout == 1, F.substring(year, 3, 2)).otherwise(year))
    left = F.when(
        week < 10, F.concat(stem, F.lit(" "), week.cast("string"), F.lit(" 1.10 0.2"))
    ).otherwise(F.concat(stem, week.cast("string"), F.lit(" 0.10 7")))
    cmi = F.format_string("%.2f", (F.col("o_orderkey") % 800 - 400) / 100.0)
    line = F.concat(F.lit(" "), left, F.lit(".  3.10 0.20 "), cmi, F.lit(" 0.80 0.90 2.00 "))
    return o.select(layout.alias("layout"), line.alias("value"))


def _cmi_files(spark, sf):
    folder = fresh_folder(spark, "cmi")
    lines = _cmi_lines(spark, sf)
    lines.where("layout = 1").select("value").write.text(f"{folder}/palmer73.txt")
    lines.where("layout = 2").select("value").write.text(f"{folder}/palmer97.txt")
    return sources.read_cmi_text(spark, f"{folder}/*.txt")


@query
def scan_cmi_text(spark, sf):
    return _cmi_files(spark, sf)


@query
def cmi_parse(spark, sf):
    return sources.station_records(sources.parse_cmi_lines(_cmi_files(spark, sf)))


@query
def scan_cmi_csv(spark, sf):
    """The parsed index records written out as CSV and read back with types."""
    folder = fresh_folder(spark, "cmi-csv")
    sources.write_csv(sources.station_records(sources.parse_cmi_lines(_cmi_files(spark, sf))), folder)
    return sources.read_cmi_csv(spark, folder)


@query
def sink_csv(spark, sf):
    folder = fresh_folder(spark, "csv")
    sources.write_csv(hourly(spark, sf).events.select(STATION, "Press_Evt_lab", "St", "End", "Dur", "Sum_Press_Delta"), folder)
    back = spark.read.option("header", True).csv(folder)
    return back.select(
        STATION, F.col("Press_Evt_lab").cast("long").alias("Press_Evt_lab"),
        *[F.to_timestamp(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("St", "End")],
        *[as_double(c).alias(c) for c in ("Dur", "Sum_Press_Delta")],
    )


@query
def sink_events(spark, sf):
    folder = fresh_folder(spark, "events")
    sources.write_events(labels_events(spark, sf), folder)
    return spark.read.parquet(folder).select(STATION, "Evt_lab", "Start", "End", "TotalRain")


def labels_events(spark, sf):
    return events.rain_spells(hourly(spark, sf).spells)


@query
def dim_lookup(spark, sf):
    """Station-dimension lookup; Spark broadcasts a dimension only after seeing its size."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    dim = nation.join(region, nation.n_regionkey == region.r_regionkey)
    s = table(spark, sf, "supplier")
    return s.join(dim, s.s_nationkey == dim.n_nationkey, "left").select("s_suppkey", "n_name", "r_name")


@query
def grid_sequence(spark, sf):
    """Every day between the first and the last shipment of each flag."""
    ends = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.unix_date(F.min("l_shipdate").cast("date")).cast("long").alias("a"),
        F.unix_date(F.max("l_shipdate").cast("date")).cast("long").alias("b"),
    )
    days = explode_range(ends, F.col("a"), F.col("b"), "d")
    return days.select("l_returnflag", F.date_from_unix_date(F.col("d").cast("int")).alias("day"))


@query
def prediction_grid(spark, sf):
    """Grid over two numeric ranges taken from the data, without a join."""
    ends = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        *[f(c).alias(f"{c}_{n}") for c in ("l_quantity", "l_discount") for n, f in (("a", F.min), ("b", F.max))]
    )
    x = fit.expand_axis(ends, "x", F.col("l_quantity_a"), F.col("l_quantity_b"), 0.5)
    y = fit.expand_axis(x, "y", F.col("l_discount_a"), F.col("l_discount_b"), 0.01)
    return y.select("l_returnflag", "x", "y")


# -- projections, filters, bins --------------------------------------------------------------


@query
def project_rename(spark, sf):
    return hourly_readings(spark, sf).withColumnsRenamed({"Rain": "Precip_mm", TIME: "End"}).select(
        STATION, "End", "Precip_mm", "Pressure_hPa"
    )


@query
def project_derive(spark, sf):
    r = hourly_readings(spark, sf).select(STATION, TIME, "Temp_C", "DewPt_C")
    return r.withColumns(
        {"Yr": F.year(TIME), "Mon": F.month(TIME), "Wk": week_of_year(TIME), "Day": F.dayofmonth(TIME), "h": F.hour(TIME)}
    ).withColumn("diff", F.col("Temp_C") - F.col("DewPt_C")).withColumn("warm", (F.col("diff") > 5).cast("int"))


@query
def project_drop_suffix(spark, sf):
    return drop_suffixes(table(spark, sf, "lineitem"), "key", "status")


@query
def unite_time(spark, sf):
    r = table(spark, sf, "events").select(
        "event_id", F.date_format("ts", "yyyyMMdd").alias("Date"), F.date_format("ts", "HHmm").alias("HrMn")
    )
    return sources.unite_time(r)


@query
def fill_null(spark, sf):
    s = grid.regularise(hourly_readings(spark, sf))
    return s.select(STATION, TIME, "Temp_C").withColumn("Rain0", F.coalesce(F.col("Temp_C"), F.lit(0.0))).drop("Temp_C")


@query
def clean_sentinel(spark, sf):
    v = F.col("l_extendedprice") % 1000
    rain = F.col("l_extendedprice") / 20 - 100
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(v <= 900, v).alias("Temp"), grid.clean_rain(rain).alias("Rain")
    ).where(F.col("Temp").isNotNull())


@query
def clean_quality_flag(spark, sf):
    flag = F.when(F.col("l_linenumber") != 5, F.col("l_linenumber").cast("string"))
    raw = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_linestatus") == "F", F.lit("01")).otherwise(F.lit("06")).alias("Precip_Pr1"),
        flag.alias("Precip_Q1"),
        F.col("l_quantity").alias("Precip_Amt1"),
        *[F.lit(None).cast("double").alias(c) for c in ("Temp", "DewPt", "SLP", "RHX")],
    )
    return sources.clean_isd(raw).select("l_orderkey", "l_linenumber", "Precip_Amt1")


@query
def filter_time_range(spark, sf):
    return stats.case_study(hourly_readings(spark, sf), "click-1", "2024-01-05 06:00:00", "2024-01-20 15:00:00")


@query
def filter_prefix(spark, sf):
    """Index records of one state, by id prefix, with ids of at most ten characters."""
    parsed = sources.parse_cmi_lines(_cmi_files(spark, sf))
    return parsed.where(F.col("id").rlike(cmi_text.STATE_PREFIX))


@query
def filter_magnitude(spark, sf):
    e = daily_events(spark, sf)
    epc = F.col("Sum_Press_Delta")
    return e.where(
        (F.abs(epc) > 5.5)
        & ~((F.col("MonT") > 20) & (F.col("Mon") < 2))
        & ((F.col("MonT") >= 1) | (F.col("MonT") <= -1))
        & ((F.log("Dur") > 0.5) | (F.col("Sum_Precip") <= 0))
    ).select(STATION, "Press_Evt_lab", "Sum_Press_Delta", "MonT", "Dur")


@query
def filter_event_quality(spark, sf):
    epc = F.col("Sum_Press_Delta")
    return daily_events(spark, sf).where(
        (F.col("Press_NA") < 7) & (epc > -2000) & (epc < 2000) & (F.col("Sum_Precip") > 0.01)
    ).select(STATION, "Press_Evt_lab", "Press_NA", "Sum_Press_Delta", "Sum_Precip")


@query
def label_half_year(spark, sf):
    return daily_events(spark, sf).select(
        STATION, "Press_Evt_lab", half_year("Mon").alias("YrSide"), wet_dry("Mon").alias("season"),
        wet_dry("Mon", 4, 10).alias("long_season"), pce_type("Sum_Press_Delta").alias("PCEType"),
    )


@query
def bin_cut(spark, sf):
    return daily_events(spark, sf).select(
        STATION, "Press_Evt_lab", month_season("Mon").alias("Season"),
        epc_band("Sum_Press_Delta").alias("band_300"), epc_band("Sum_Press_Delta", EPC_EDGES_500).alias("band_500"),
    )


@query
def bin_round(spark, sf):
    return daily_events(spark, sf).select(
        STATION, "Press_Evt_lab", round_step("Sum_Press_Delta", 20).alias("epc20"),
        round_step("Sum_Press_Delta", 80).alias("epc80"), round_step("MonT", 0.2).alias("amt02"), round_step("MonT").alias("amt1"),
    )


@query
def bin_floor(spark, sf):
    return daily_events(spark, sf).select(
        STATION, "Press_Evt_lab", floor_step("Sum_Press_Delta", 30).alias("epc30"),
        floor_step("MonT", 1).alias("amt1"), log_step("Sum_Precip", 0.5).alias("log_pd"),
    )


@query
def distinct_rows(spark, sf):
    return daily_readings(spark, sf).select(STATION, F.year(TIME).alias("Yr")).distinct()


@query
def season_overlay(spark, sf):
    return stats.season_overlay(stats.depth_sample(daily_events(spark, sf), None, "month"))


# -- joins ------------------------------------------------------------------------------------


@query
def join_event_amt(spark, sf):
    return events.pressure_events(daily(spark, sf).parts, lags=False).select(
        STATION, "Press_Evt_lab", "Yr", "Mon", "MonT"
    )


@query
def gap_frequent(spark, sf):
    lags = grid.reading_lags(daily(spark, sf).buckets, 1440)
    return grid.recurrent_lags(lags, *DAILY_RECURRENT).select(STATION, "St", "End", "TimeLag_min")


@query
def interval_overlap_join(spark, sf):
    c = hourly(spark, sf)
    ev = c.events_before_gaps.select(STATION, "Press_Evt_lab", "St", "End")
    return events.overlap_join(c.gaps, ev)


@query
def anti_join_gaps(spark, sf):
    return hourly(spark, sf).gap_free_series.select(STATION, TIME, "Press_Evt_lab", "Evt_lab", "Rain", "pressure_chng_av")


@query
def join_cmi(spark, sf):
    return drought.join_cmi(daily_readings(spark, sf), cmi_values(spark, sf)).select(STATION, TIME, "Temp_C", "CMI")


@query
def join_cmi_shift(spark, sf):
    """The day-of-month shift and the calendar shift, side by side."""
    r, cmi = daily_readings(spark, sf).select(STATION, TIME, "RH"), cmi_values(spark, sf)
    r = drought.join_cmi_shift(r, cmi, "day_of_month", "CMI_pre")
    return drought.join_cmi_shift(r, cmi, "calendar", "CMI_before")


@query
def regularise_series(spark, sf):
    return grid.regularise(hourly_readings(spark, sf)).select(SERIES)


@query
def union_sources(spark, sf):
    a = hourly_readings(spark, sf).drop("Wind_SP_m_s")
    b = daily_readings(spark, sf).drop("RH")
    return sources.union_sources(a, b).select(SERIES)


# -- aggregates -----------------------------------------------------------------------------------


@query
def hourly_bucket_mean(spark, sf):
    b = grid.bucket_mean(hourly_readings(spark, sf))
    return grid.with_time(b).select(SERIES)


@query
def gap_table(spark, sf):
    b = grid.bucket_mean(hourly_readings(spark, sf))
    return grid.gap_table(b, recurrent=(60, 240, 3)).select(STATION, "St", "End", "TimeLag_min", "Years")


@query
def rain_events(spark, sf):
    return labels_events(spark, sf)


@query
def dry_events(spark, sf):
    return events.dry_spells(hourly(spark, sf).spells)


@query
def monthly_temp(spark, sf):
    s = hourly(spark, sf).series.unionByName(daily(spark, sf).series)
    own = events.monthly_temp(s)
    pooled = events.monthly_temp(s, pooled=True).withColumn(STATION, F.lit("all"))
    return own.unionByName(pooled)


@query
def pressure_events(spark, sf):
    return hourly(spark, sf).events_before_gaps


@query
def pressure_events_gap_free(spark, sf):
    return hourly(spark, sf).events


@query
def event_lags(spark, sf):
    return daily(spark, sf).events.select(STATION, "Press_Evt_lab", "St", "Dur_lag1", "Press_Delta_lag1")


@query
def event_lags_pooled(spark, sf):
    """The previous event by start time over all stations together."""
    return events.pressure_events(hourly(spark, sf).parts, pooled_lags=True).select(
        STATION, "Press_Evt_lab", "St", "Dur_lag1", "Press_Delta_lag1"
    )


@query
def pop_by_epc(spark, sf):
    return stats.pop_by_epc(daily_events(spark, sf))


@query
def pop_by_epc_hourly(spark, sf):
    return stats.pop_by_epc(hourly(spark, sf).events_before_gaps, 80)


@query
def pce_frequency(spark, sf):
    return stats.pce_frequency(daily_events(spark, sf), 10)


@query
def pce_frequency_by_station(spark, sf):
    return stats.pce_frequency(hourly(spark, sf).events_before_gaps, 90, by_station=True)


@query
def pop_by_amt(spark, sf):
    e = daily_events(spark, sf)
    parts = [stats.pop_by_amt(e, k).withColumn("kind", F.lit(k)) for k in ("de", "in", "both")]
    return sources.union_sources(parts[2], parts[0], parts[1])


@query
def pop_surface(spark, sf):
    return stats.pop_surface(daily_events(spark, sf))


@query
def pop_surface_tiles(spark, sf):
    return stats.pop_surface(daily_events(spark, sf), 20, 1, percent=True)


@query
def depth_quantiles(spark, sf):
    return stats.depth_quantiles(daily_events(spark, sf))


@query
def depth_quantile_surface(spark, sf):
    return stats.depth_quantile_surface(daily_events(spark, sf))


@query
def unpivot_quantiles(spark, sf):
    e = daily_events(spark, sf)
    names = ["95%", "75%", "50%"]
    wide = quantiles.exact_quantiles(e, [STATION], "Dur", stats.PROBS, names)
    return stats.unpivot_quantiles(wide, [STATION], names)


@query
def neighbour_fanout(spark, sf):
    return stats.neighbour_fanout(stats.depth_sample(daily_events(spark, sf), 7), stats.FANOUT)


@query
def tail_mean(spark, sf):
    return stats.tail_mean(daily_events(spark, sf), 7)


@query
def tail_mean_zero(spark, sf):
    return stats.tail_mean(daily_events(spark, sf), 7, empty="zero", limit=None)


@query
def extreme_events(spark, sf):
    return stats.extreme_events(daily_events(spark, sf)).select(STATION, "Press_Evt_lab", "Sum_Precip")


@query
def extreme_pop_by_epc(spark, sf):
    return stats.pop_by_epc(stats.extreme_events(daily_events(spark, sf)))


@query
def weekly_cmi(spark, sf):
    return weeks_of(spark, sf)


@query
def weekly_drought(spark, sf):
    """From readings and index to weeks far below the mean index: spline fill, gaps removed."""
    return entries.weekly_drought(daily_readings(spark, sf), cmi_values(spark, sf), DAILY, "day_of_month", *RANGE)


@query
def weekly_precipitation(spark, sf):
    """From hourly readings to weekly means of a three-day precipitation index: spline fill, gaps removed."""
    return entries.weekly_precipitation_index(hourly_readings(spark, sf), HOURLY, 3, None, pooled=True)


@query
def weekly_means(spark, sf):
    return drought.weekly_means(daily_cmi(spark, sf).gap_free_series, True, *RANGE)


@query
def weekly_pce_count(spark, sf):
    return drought.weekly_pce_count(daily_cmi(spark, sf).gap_free_series, True, *RANGE)


@query
def zscore_filter(spark, sf):
    return drought.zscore_filter(weeks_of(spark, sf)).select(
        STATION, "Yr", "Mon", "Wk", "CMI", "CMI_standarize"
    )


@query
def weekly_extract(spark, sf):
    rows = drought.weekly_pce_count(daily_cmi(spark, sf).gap_free_series, True, *RANGE)
    return drought.weekly_extract(rows, None, "wet_dry", (4, 10), 0.5, 5)


@query
def weekly_extract_dry(spark, sf):
    """Weeks far below the mean index, with bounds on the dew-point gap and on the other week."""
    weeks = drought.zscore_filter(weeks_of(spark, sf))
    cond = (F.col("Temp_dew_diff") > 0) & (F.log("Temp_dew_diff") > 1) & (F.col("CMI_pre") <= 0)
    return drought.weekly_extract(weeks, None, "pce", condition=cond).select(
        "Yr", "Mon", "Wk", STATION, "CMI_standarize", "Temp_dew_diff", "cum_Pressure_chng", "wet_dry"
    )


@query
def daily_agg(spark, sf):
    return drought.daily_agg(hourly(spark, sf).gap_free_series)


@query
def rolling_rain(spark, sf):
    return drought.rolling_rain(drought.daily_agg(daily(spark, sf).series)).select(STATION, "Time_SPI", "rain_sum")


@query
def spi_gamma_params(spark, sf):
    return drought.spi_gamma_params(drought.rolling_rain(drought.daily_agg(daily(spark, sf).series)))


def _spi(spark, sf, pooled=False):
    """Index from the gap-filled days, next to the daily ranges of the raw readings."""
    d = drought.daily_agg(daily(spark, sf).series)
    return drought.spi_daily(d, 30, (1995, 2001), pooled), drought.daily_agg(daily_readings(spark, sf))


@query
def spi_daily(spark, sf):
    return _spi(spark, sf)[0]


@query
def spi_daily_pooled(spark, sf):
    return _spi(spark, sf, True)[0]


@query
def join_spi_daily(spark, sf):
    return drought.join_spi_daily(*_spi(spark, sf))


@query
def weekly_spi(spark, sf):
    return drought.weekly_spi(drought.join_spi_daily(*_spi(spark, sf)))


@query
def monthly_spi(spark, sf):
    return drought.monthly_spi(drought.join_spi_daily(*_spi(spark, sf)))


@query
def gap_census(spark, sf):
    return grid.gap_census(hourly(spark, sf).buckets)


@query
def pop_by_slp(spark, sf):
    return stats.pop_by_pressure(hourly(spark, sf).series)


@query
def pop_by_slp_month(spark, sf):
    return stats.pop_by_pressure(daily(spark, sf).series, by_month=True)


@query
def daily_pressure_hist(spark, sf):
    return stats.daily_pressure_hist(hourly(spark, sf).series)


@query
def tail_sample_size(spark, sf):
    return stats.tail_sample_size(daily_events(spark, sf), below=5)


@query
def tail_sample_size_fanned(spark, sf):
    return stats.tail_sample_size_fanned(daily_events(spark, sf), 0, 10)


@query
def hist_amt(spark, sf):
    return stats.hist_amt(daily_events(spark, sf))


@query
def box_stats(spark, sf):
    return quantiles.box_stats(events.monthly_temp(daily(spark, sf).series), ["Mon"], "MonT")


@query
def event_scatter(spark, sf):
    return stats.event_scatter(daily_events(spark, sf))


@query
def event_scatter_amt(spark, sf):
    return stats.event_scatter(daily_events(spark, sf), "amt")


# -- windows --------------------------------------------------------------------------------------


@query
def rolling_sum(spark, sf):
    return smooth.rolling_sums(grid.regularise(hourly_readings(spark, sf))).select(STATION, TIME, "sum_left", "sum_right")


@query
def rolling_mean_centered(spark, sf):
    s = grid.with_time(smooth.fill_and_pad(grid.bucket_mean(hourly_readings(spark, sf)), "linear"))
    return smooth.rolling_means(s, {"pressure_spl": "pressure_av"}).select(STATION, TIME, "pressure_av")


def _smooth_variables(spark, sf, fill):
    names = {"Pressure_hPa": "slp", "Temp_C": "temp", "DewPt_C": "dewpt", "RH": "rhx"}
    b = grid.bucket_mean(hourly_readings(spark, sf))
    s = smooth.fill_and_pad(b, fill, columns={c: f"{n}_spl" for c, n in names.items()})
    out = smooth.rolling_means(grid.with_time(s), {f"{n}_spl": f"{n}_av" for n in names.values()})
    return out.select(STATION, TIME, *[f"{n}_av" for n in names.values()])


@query
def smooth_variables(spark, sf):
    """Filled and smoothed pressure, temperature, dew point and humidity."""
    return _smooth_variables(spark, sf, "linear")


@query
def smooth_variables_spline(spark, sf):
    """The same with the spline fill; one solve serves the four."""
    return _smooth_variables(spark, sf, "spline")


@query
def pressure_change_24h(spark, sf):
    s = grid.with_time(smooth.fill_and_pad(grid.bucket_mean(hourly_readings(spark, sf)), "linear"))
    return smooth.pressure_change(s).select(STATION, TIME, "pressure_chng_av")


@query
def rain_dry_labels(spark, sf):
    return labels.label_rain_dry(grid.regularise(hourly_readings(spark, sf))).select(
        STATION, TIME, "Rain", "StR", "StD", "Evt_lab"
    )


@query
def rain_dry_labels_b(spark, sf):
    return labels.label_rain_dry(grid.regularise(hourly_readings(spark, sf)), rule="B").select(
        STATION, TIME, "Rain", "StR", "StD", "Evt_lab"
    )


@query
def pressure_event_labels(spark, sf):
    s = grid.with_time(smooth.fill_and_pad(grid.bucket_mean(daily_readings(spark, sf), 1440), "linear"), 1440)
    return labels.label_pressure_events(smooth.pressure_change(s)).select(
        STATION, TIME, "Mon", "pressure_chng_av", "Press_Evt_lab"
    )


# -- fills, fits, densities ------------------------------------------------------------------------


@query
def linear_fill(spark, sf):
    s = smooth.fill_and_pad(grid.bucket_mean(daily_readings(spark, sf), 1440), "linear")
    return grid.with_time(s, 1440).select(STATION, TIME, "Pressure_hPa", "pressure_spl")


@query
def spline_fill(spark, sf):
    s = smooth.fill_and_pad(grid.bucket_mean(daily_readings(spark, sf), 1440), "spline")
    return grid.with_time(s, 1440).select(STATION, TIME, "Pressure_hPa", "pressure_spl")


@query
def harmonic_normal_eq(spark, sf):
    s = grid.regularise(hourly_readings(spark, sf))
    return smooth.harmonic_normal_equations(smooth.hourly_change(s))


@query
def harmonic_fill(spark, sf):
    return smooth.harmonic_fill(grid.regularise(hourly_readings(spark, sf))).select(STATION, TIME, "Temp_C", "temp_cure")


@query
def pce_curated_events(spark, sf):
    """The whole chain with the spline fill and gap removal, all stations."""
    return hourly(spark, sf, "spline").events


@query
def kde_1d(spark, sf):
    e = daily_events(spark, sf).where(F.abs("Sum_Press_Delta") > 5.5)
    both = [fit.kde_1d(d, "Sum_Press_Delta", 256).withColumn("kind", F.lit(k))
            for k, d in (("all", e), ("rainy", e.where(F.col("St_Rain") > 0)))]
    return both[0].unionByName(both[1])


@query
def kde_2d(spark, sf):
    e = daily_events(spark, sf).where(F.col("Sum_Precip") > 0)
    return fit.kde_2d(e, "Sum_Press_Delta", "Sum_Precip")


@query
def kde_2d_by_half(spark, sf):
    """Density of events over temperature and pressure change, per half-year."""
    e = daily_events(spark, sf).select(
        half_year("Mon").alias("YrSide"), round_step("MonT", 0.2).alias("MonT"), round_step("Sum_Press_Delta").alias("EPC")
    )
    return fit.kde_2d(e, "MonT", "EPC", by=["YrSide"])


@query
def kde_1d_wet_hours(spark, sf):
    """Density of the pressure change over all hours with rain, all stations together."""
    return fit.kde_1d(hourly(spark, sf).series.where("Rain > 0"), "pressure_chng_av", 256)


@query
def local_curve(spark, sf):
    pts = stage(stats.pop_by_epc(daily_events(spark, sf)), "points")
    return fit.local_curve(pts, "Evt_Press_chng", "RainProb")


@query
def local_curve_band(spark, sf):
    """POP of falling-pressure events by temperature, a curve and its 95 % band per half-year."""
    pts = stats.pop_by_amt(daily_events(spark, sf), "de")
    return curves.local_curves(pts, "MonT", "RainProb", ["YrSide"], band=0.95)


@query
def local_curve_by_group(spark, sf):
    pts = stats.pop_by_amt(daily_events(spark, sf), "both")
    return curves.local_curves(pts, "MonT", "RainProb", ["YrSide", "PCEType"])


@query
def frequency_smooth(spark, sf):
    """Events a month and station by temperature: a penalised spline with its band per half-year."""
    e = daily_events(spark, sf)
    months = e.groupBy(STATION, "Yr", "Mon", "MonT").agg(F.count("*").cast("double").alias("n_events"))
    months = months.withColumn("YrSide", half_year("Mon"))
    return curves.regression_spline(months, "MonT", "n_events", ["YrSide"], penalty=50.0, band=0.95)


@query
def local_surface(spark, sf):
    return fit.local_surface(stage(stats.pop_surface(daily_events(spark, sf)), "surface"))


@query
def local_surface_extreme(spark, sf):
    """The surface of the events with much rain, on their own grid."""
    surface = stats.pop_surface(stats.extreme_events(daily_events(spark, sf)))
    return fit.local_surface(stage(surface, "surface"), fit.EXTREME_GRID)


@query
def local_surface_older(spark, sf):
    return fit.local_surface(stage(stats.pop_surface(daily_events(spark, sf)), "surface"), fit.OLDER_GRID)


@query
def monday_dates(spark, sf):
    """Week number of the year and the Monday it starts on."""
    o = table(spark, sf, "orders")
    wk = F.floor((F.dayofyear("o_orderdate") - 1) / 7)
    return o.select("o_orderkey", monday_of_week(F.year("o_orderdate"), wk).alias("monday"))

