"""Crop-moisture-index joins, weekly drought summaries and the precipitation index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baroflow.functions import numerics
from baroflow.functions.bins import floor_step, wet_dry
from baroflow.functions.dates import week_of_year
from baroflow.functions.nulls import safe_ratio, snap, strict_avg, strict_max, strict_min, strict_sum
from baroflow.operators.blocks import block_window, owned, with_halo
from baroflow.operators.smooth import at, run_length, shifted_sum
from baroflow.operators.stats import with_week
from baroflow.plans.staging import stage
from baroflow.schema import BLOCK, STATION, TIME

WEEK_KEYS = ["Yr", "Mon", "Wk", STATION]


# -- CMI joins -------------------------------------------------------------------------


def _keyed(cmi: DataFrame, name: str, shift_days: int = 0) -> DataFrame:
    hour = F.date_trunc("hour", F.col("ymd_hms"))
    return cmi.select(
        F.col("location").alias(STATION),
        (hour + F.make_dt_interval(F.lit(shift_days))).alias("_hour"),
        F.col("CMI").cast("double").alias(name),
    )


def join_cmi(readings: DataFrame, cmi: DataFrame, name: str = "CMI") -> DataFrame:
    """Index value of the same station, day and hour (one truncated-time key)."""
    keyed = readings.withColumn("_hour", F.date_trunc("hour", F.col(TIME)))
    return keyed.join(_keyed(cmi, name), [STATION, "_hour"], "left").drop("_hour")


def join_cmi_shift(
    readings: DataFrame, cmi: DataFrame, mode: str = "calendar", name: str = "CMI_pre"
) -> DataFrame:
    """Index value of another week.

    ``calendar`` takes the value seven days earlier.  ``day_of_month`` subtracts seven from
    the day number of the index date, which picks the value seven days *later* and finds
    none across a month border.
    """
    if mode == "calendar":
        other = _keyed(cmi, name, 7)
    elif mode == "day_of_month":
        other = _keyed(cmi.where(F.dayofmonth("ymd_hms") > 7), name, -7)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    keyed = readings.withColumn("_hour", F.date_trunc("hour", F.col(TIME)))
    return keyed.join(other, [STATION, "_hour"], "left").drop("_hour")


# -- weekly summaries --------------------------------------------------------------------


def _week_rows(series: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start is not None:
        series = series.where(F.col(TIME).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    filled = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("CMI", "CMI_pre") if c in series.columns}
    return with_week(series.withColumns(filled) if filled else series)


PCE_NUM = "PCE_num"


def weekly_cmi(series: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Weekly sums; the per-event ratios divide by the number of label changes in the week."""
    sums = _week_rows(series, start, end).groupBy(*WEEK_KEYS).agg(
        snap(strict_sum("CMI")).alias("CMI"),
        snap(strict_sum("CMI_pre")).alias("CMI_pre"),
        (F.max("Press_Evt_lab") - F.min("Press_Evt_lab")).alias(PCE_NUM),
        strict_sum("Rain").alias("wk_Rain"),
        strict_sum("Temp_C").alias("cum_Temp"),
        strict_sum("RH").alias("cum_RH"),
        strict_sum(F.col("Temp_C") - F.col("DewPt_C")).alias("Temp_dew_diff"),
        strict_sum("pressure_chng_av").alias("cum_Pressure_chng"),
    )
    ratio = {c: F.coalesce(safe_ratio(snap(c), PCE_NUM), F.lit(0.0)) for c in ("cum_Temp", "cum_RH", "Temp_dew_diff")}
    return sums.withColumns({**ratio, "wk_Rain": F.coalesce("wk_Rain", F.lit(0.0))})


def weekly_means(
    series: DataFrame, keep_rows: bool = False, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Weekly means per label change; ``keep_rows`` repeats them on every row with its time."""
    rows = _week_rows(series, start, end)
    sums = rows.groupBy(*WEEK_KEYS).agg(
        snap(strict_sum("CMI")).alias("CMI"),
        (F.max("Press_Evt_lab") - F.min("Press_Evt_lab")).alias(PCE_NUM),
        strict_avg("Temp_C").alias("mean_Temp"),
        strict_avg("RH").alias("mean_RH"),
        strict_avg(F.col("Temp_C") - F.col("DewPt_C")).alias("Temp_dew_diff"),
    )
    ratio = {c: F.coalesce(safe_ratio(snap(c), PCE_NUM), F.lit(0.0)) for c in ("mean_Temp", "mean_RH", "Temp_dew_diff")}
    weeks = sums.withColumns(ratio)
    if not keep_rows:
        return weeks
    return rows.select(*WEEK_KEYS, TIME).join(weeks, WEEK_KEYS)


def weekly_pce_count(
    series: DataFrame, keep_rows: bool = True, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Number of label changes, index and rain of each week, on every row of the week."""
    rows = _week_rows(series, start, end)
    weeks = (
        rows.groupBy(*WEEK_KEYS)
        .agg(
            (F.max("Press_Evt_lab") - F.min("Press_Evt_lab")).alias(PCE_NUM),
            snap(strict_sum("CMI")).alias("CMI"),
            snap(strict_sum("Rain")).alias("Rain"),
        )
        .withColumn("year_wk", F.concat_ws(" ", F.col("Yr").cast("string"), F.col("Wk").cast("string")))
    )
    if not keep_rows:
        return weeks
    return rows.select(*WEEK_KEYS, TIME).join(weeks, WEEK_KEYS)


def zscore_filter(weeks: DataFrame, column: str = "CMI", below: float = -1) -> DataFrame:
    """Weeks whose standardised value, over all stations together, is under ``below``."""
    stats = weeks.agg(F.struct(F.avg(column).alias("m"), F.stddev_samp(column).alias("s")))
    z = (F.col(column) - F.col("_st.m")) / F.col("_st.s")
    out = weeks.withColumn("_st", stats.scalar())
    return (
        out.withColumn("CMI_standarize", F.when(F.col("_st.s") > 0, snap(z))).drop("_st")
        .where(F.col("CMI_standarize") < below)
    )


def weekly_extract(
    weeks: DataFrame,
    station: str | None = None,
    label: str | None = "wet_dry",
    season: tuple[int, int] = (4, 10),
    min_abs_cmi: float | None = None,
    max_pce: int | None = None,
    condition: Column | None = None,
) -> DataFrame:
    """Distinct week rows with a season or event-count label, the time column left out.

    ``condition`` adds any further row filter, such as a bound on the dew-point gap.
    """
    if station is not None:
        weeks = weeks.where(F.col(STATION) == station)
    if min_abs_cmi is not None:
        weeks = weeks.where((F.col("CMI") >= min_abs_cmi) | (F.col("CMI") <= -min_abs_cmi))
    if max_pce is not None:
        weeks = weeks.where(F.col(PCE_NUM) <= max_pce)
    if condition is not None:
        weeks = weeks.where(condition)
    if label == "wet_dry":
        weeks = weeks.withColumn("wet_dry", wet_dry("Mon", *season))
    elif label == "pce":
        weeks = weeks.withColumn("wet_dry", F.when(F.col(PCE_NUM) > 2, F.lit(">2")).otherwise(F.lit("<2")))
    return weeks.drop(TIME).distinct()


# -- daily series and standardised precipitation index --------------------------------------


def daily_agg(series: DataFrame) -> DataFrame:
    day = F.to_date(TIME)
    return (
        series.groupBy(STATION, day.alias("Time_SPI"))
        .agg(
            snap(strict_sum("Rain")).alias("Day_rain"),
            snap(strict_max("Pressure_hPa") - strict_min("Pressure_hPa")).alias("Day_Pressure_chng_av"),
            snap(strict_avg(F.col("Temp_C") - F.col("DewPt_C"))).alias("Temp_dew_diff"),
        )
        .withColumns({"Yr": F.year("Time_SPI"), "Mon": F.month("Time_SPI")})
    )


def rolling_rain(daily: DataFrame, days: int = 30, block_days: int = 2048) -> DataFrame:
    """Rain over the last ``days`` days on every row; NULL unless every one of them is known.

    Expects one row per station and day.  ``days`` rows reach back exactly ``days - 1``
    days if and only if none is missing, and their sum is NULL if any rain is.
    """
    d = daily.select(STATION, "Time_SPI", "Day_rain", F.unix_date("Time_SPI").cast("long").alias("day"))
    w = block_window(order="day")
    size = run_length(days)
    h = with_halo(d, days - 1, 0, order="day", size=block_days)
    h = h.withColumn("_run", shifted_sum("Day_rain", range(1 - size, 1), w))
    full = F.col("day") - at("day", 1 - days, w) == days - 1
    total = shifted_sum("_run", range(size - days, 1, size), w)
    out = h.withColumn("rain_sum", F.when(full, snap(total)))
    return owned(out).drop(BLOCK, "day", "_run")


def spi_gamma_params(rolled: DataFrame, pooled: bool = False) -> DataFrame:
    """Gamma shape and scale (Thom's closed form) and share of zeros by calendar day, from known sums."""
    x = F.col("rain_sum")
    wet = F.when(x > 0, x)
    keys = ([] if pooled else [STATION]) + ["doy"]
    known = rolled.where(x.isNotNull())
    fit = known.withColumn("doy", F.dayofyear("Time_SPI")).groupBy(*keys).agg(
        F.count("*").alias("n"),
        (F.count_if(x == 0) / F.count("*")).alias("zero_share"),
        F.avg(wet).alias("mean"),
        F.avg(F.log(wet)).alias("log_mean"),
    )
    a = F.col("_a")
    shape = F.when(a > 1e-9, (F.sqrt(a * 4.0 / 3.0 + 1.0) + 1.0) / (a * 4.0))
    return (
        # A difference of near-equal logarithms: its last digits are noise.
        fit.withColumn("_a", snap(F.log("mean") - F.col("log_mean"), 12))
        .withColumn("shape", shape)
        .withColumn("scale", F.col("mean") / F.col("shape"))
        .select(*keys, "n", "zero_share", "shape", "scale")
    )


def _index():
    def index(x: pd.Series, zero: pd.Series, shape: pd.Series, scale: pd.Series) -> pd.Series:
        rain, q = x.to_numpy(np.float64), zero.to_numpy(np.float64)
        g = numerics.gamma_cdf(shape.to_numpy(np.float64), rain / scale.to_numpy(np.float64))
        # A dry spell carries the zero mass whether or not a distribution could be fitted.
        g = np.where(rain == 0, 0.0, g)
        z = numerics.normal_quantile(q + (1.0 - q) * g)
        return pd.Series(np.where(np.isfinite(z), z, np.nan))

    index.__annotations__ = {k: pd.Series for k in ("x", "zero", "shape", "scale", "return")}
    return F.pandas_udf(index, "double")


def spi_daily(
    daily: DataFrame, days: int = 30, years: tuple[int, int] | None = None, pooled: bool = False
) -> DataFrame:
    """Standardised precipitation index per station and day.

    Rolling sums are fitted by calendar day with a gamma distribution plus a mass at zero
    and mapped to standard-normal quantiles.  ``pooled`` fits all stations together.
    ``years`` limits the dates returned, not the dates fitted.  Every day has a row; its
    index is NULL where the rolling sum is.
    """
    rolled = stage(rolling_rain(daily, days), "rolled")
    params = spi_gamma_params(rolled, pooled)
    keys = ([] if pooled else [STATION]) + ["doy"]
    out = rolled.withColumn("doy", F.dayofyear("Time_SPI"))
    if years is not None:
        out = out.where(F.year("Time_SPI").between(*years))
    return out.join(params, keys, "left").select(
        STATION,
        F.col("Time_SPI").alias("time_stamp"),
        "rain_sum",
        _index()("rain_sum", "zero_share", "shape", "scale").alias("value"),
    )


def join_spi_daily(spi: DataFrame, daily: DataFrame) -> DataFrame:
    right = daily.select(
        STATION, F.col("Time_SPI").alias("time_stamp"), "Day_rain", "Day_Pressure_chng_av", "Temp_dew_diff"
    )
    return spi.join(right, [STATION, "time_stamp"], "left").select(
        STATION, "time_stamp", "value", "Day_rain", "Day_Pressure_chng_av", "Temp_dew_diff"
    )


def weekly_spi(joined: DataFrame, band: float = 40) -> DataFrame:
    t = F.col("time_stamp")
    return (
        joined.groupBy(STATION, F.year(t).alias("Yr"), F.month(t).alias("Mon"), week_of_year(t).alias("Wk"))
        .agg(
            F.avg("value").alias("spi_av"),
            snap(F.coalesce(F.sum("Day_Pressure_chng_av"), F.lit(0.0))).alias("pre_sum"),
            snap(F.coalesce(F.sum("Temp_dew_diff"), F.lit(0.0))).alias("diff_T_D"),
        )
        .where(F.col("pre_sum") != 0)
        .withColumn("dew_band", floor_step("diff_T_D", band))
    )


def monthly_spi(joined: DataFrame) -> DataFrame:
    t = F.col("time_stamp")
    return joined.groupBy(STATION, F.year(t).alias("Yr"), F.month(t).alias("Mon")).agg(
        strict_avg("value").alias("SPI"),
        strict_avg("Day_Pressure_chng_av").alias("pressure_chng"),
        strict_avg("Temp_dew_diff").alias("temp_dew"),
    )
