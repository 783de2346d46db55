"""Questions asked of the event table and of the labelled series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baroflow.functions.bins import (
    EPC_EDGES_300,
    epc_band,
    floor_step,
    half_year,
    month_season,
    pce_type,
    round_step,
    wet_dry,
)
from baroflow.functions.dates import week_of_year
from baroflow.functions.nulls import snap
from baroflow.operators.quantiles import exact_quantiles, tail_means
from baroflow.schema import STATION, TIME

PROBS = [0.95, 0.75, 0.50]
TAIL_NAMES = ["95 Percentile", "75 Percentile", "50 Percentile"]
QUANTILE_NAMES = ["95%", "75%", "50%"]
SURFACE_PROBS = [0.999, 0.99, 0.90, 0.75, 0.50, 0.25]
SURFACE_NAMES = ["99.9%", "99%", "90%", "75%", "50%", "25%"]


def rain_share(flag: Column) -> Column:
    """Share of rows with the flag set; a missing flag counts as no rain."""
    return F.sum(F.coalesce(flag, F.lit(False)).cast("int")) / F.count("*")


def _rainy() -> Column:
    return F.col("St_Rain") > 0


# -- probability of precipitation ---------------------------------------------------


def pop_by_epc(events: DataFrame, step: float = 20) -> DataFrame:
    return events.groupBy(round_step("Sum_Press_Delta", step).alias("Evt_Press_chng")).agg(
        rain_share(_rainy()).alias("RainProb"), F.count("*").alias("samplesize")
    )


def pop_by_amt(events: DataFrame, kind: str = "both", amt_step: float = 0.2) -> DataFrame:
    """POP by temperature and half-year for falling (``de``), rising (``in``) or both kinds."""
    epc = F.col("Sum_Press_Delta")
    keys = [round_step("MonT", amt_step).alias("MonT"), half_year("Mon").alias("YrSide")]
    if kind == "de":
        events = events.where(epc < 0)
    elif kind == "in":
        events = events.where(epc > 0)
    elif kind == "both":
        keys.append(pce_type(epc).alias("PCEType"))
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return events.groupBy(*keys).agg(rain_share(_rainy()).alias("RainProb"))


def pop_surface(
    events: DataFrame, epc_step: float = 1, amt_step: float = 0.2, percent: bool = False
) -> DataFrame:
    return events.groupBy(
        round_step("Sum_Press_Delta", epc_step).alias("Sum_Press_Delta"),
        round_step("MonT", amt_step).alias("MonT"),
        half_year("Mon").alias("YrSide"),
    ).agg((rain_share(_rainy()) * (100.0 if percent else 1.0)).alias("RainProb"))


def pop_by_pressure(
    series: DataFrame, column: str = "Pressure_hPa", rain: str = "Rain", by_month: bool = False
) -> DataFrame:
    """Share of hours with rain by 1-hPa bin, optionally by month name with the sample size."""
    keys = [floor_step(snap(column), 1.0).alias("SLP_v")]
    aggs = [rain_share(F.col(rain) > 0).alias("PRate")]
    if by_month:
        keys.append(F.date_format(TIME, "MMMM").alias("Mon"))
        aggs.append(F.count("*").alias("Occurance"))
    return series.groupBy(*keys).agg(*aggs)


# -- frequencies and histograms --------------------------------------------------------


def pce_frequency(events: DataFrame, min_abs: float = 90, by_station: bool = False) -> DataFrame:
    keys = [F.month("St").alias("PCE_mon"), F.col("MonT")] + ([F.col(STATION)] if by_station else [])
    return (
        events.where(F.abs("Sum_Press_Delta") > min_abs)
        .groupBy(*keys)
        .agg(F.count("*").alias("n"))
        .withColumn("HlfYr", half_year("PCE_mon", ("Jan~Jun", "Jul~Dec")))
    )


def daily_pressure(series: DataFrame, column: str = "Pressure_hPa") -> DataFrame:
    return series.groupBy(STATION, F.date_trunc("day", F.col(TIME)).alias("Date")).agg(
        snap(F.avg(column)).alias("DailySLP")
    )


def daily_pressure_hist(series: DataFrame, column: str = "Pressure_hPa") -> DataFrame:
    """Histogram of daily mean pressure by month; bins one wide, centred, closed on the right."""
    days = daily_pressure(series, column).where(F.col("DailySLP").isNotNull())
    return days.groupBy(
        F.month("Date").alias("Month"), F.ceil(F.col("DailySLP") - 0.5).cast("double").alias("bin")
    ).agg(F.count("*").alias("n"))


def hist_amt(events: DataFrame, bins: int = 30) -> DataFrame:
    """Counts of all and of rainy events in equal-width temperature bins."""
    known = events.where(F.col("MonT").isNotNull())
    ends = known.agg(F.struct(F.min("MonT").alias("lo"), F.max("MonT").alias("hi")))
    placed = known.select("MonT", _rainy().alias("rainy"), ends.scalar().alias("e"))
    share = (F.col("MonT") - F.col("e.lo")) / (F.col("e.hi") - F.col("e.lo"))
    bin_no = F.when(F.col("e.hi") > F.col("e.lo"), F.least(F.floor(share * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    return placed.groupBy(bin_no.cast("long").alias("bin")).agg(
        F.count("*").alias("n_all"), F.sum(F.coalesce(F.col("rainy"), F.lit(False)).cast("int")).alias("n_rainy")
    )


# -- precipitation depth -----------------------------------------------------------------


def depth_sample(
    events: DataFrame,
    max_na: int | None = 1,
    season: str = "wet_dry",
    epc_step: float = 30,
    amt_step: float = 1,
) -> DataFrame:
    """Rainy events on a temperature and pressure-change grid, with a season label.

    Events with ``max_na`` or more missing pressure values are left out.
    """
    if max_na is not None:
        events = events.where(F.col("Press_NA") < max_na)
    month = F.month("St")
    label = wet_dry(month) if season == "wet_dry" else month_season(month)
    return events.where(F.col("Sum_Precip") > 0).select(
        floor_step("MonT", amt_step).alias("MonT"),
        floor_step("Sum_Press_Delta", epc_step).alias("Sum_Press_Delta"),
        label.alias("Season"),
        "Sum_Precip",
    )


def neighbour_fanout(df: DataFrame, axes: dict[str, float]) -> DataFrame:
    """Count every row in its own bin and in both neighbours on each axis."""
    for name, step in axes.items():
        shifts = F.explode(F.array(*[F.lit(float(s)) for s in (-step, 0.0, step)]))
        df = df.withColumn("_shift", shifts).withColumn(name, F.col(name) + F.col("_shift")).drop("_shift")
    return df


FANOUT = {"MonT": 1.0, "Sum_Press_Delta": 30.0}
DEPTH_KEYS = ["MonT", "Sum_Press_Delta", "Season"]


def _to_neighbours(df: DataFrame) -> DataFrame:
    return neighbour_fanout(df, FANOUT)


def unpivot_quantiles(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    return df.unpivot(list(keys), [F.col(f"`{n}`") for n in names], "Qntile", "Sum_Precip")


def depth_quantiles(
    events: DataFrame, max_na: int | None = 7, season: str = "month", edges: Sequence[int] = EPC_EDGES_300
) -> DataFrame:
    sample = depth_sample(events, max_na, season)
    wide = exact_quantiles(sample, DEPTH_KEYS, "Sum_Precip", PROBS, QUANTILE_NAMES, _to_neighbours)
    return unpivot_quantiles(wide, DEPTH_KEYS, QUANTILE_NAMES).withColumn(
        "Sum_Press_C", epc_band("Sum_Press_Delta", edges)
    )


def tail_mean(
    events: DataFrame,
    max_na: int | None = 1,
    season: str = "wet_dry",
    empty: str = "null",
    edges: Sequence[int] = EPC_EDGES_300,
    limit: float | None = 2000,
) -> DataFrame:
    """Mean depth above the group quantile, after the neighbour fan-out, in long form."""
    sample = depth_sample(events, max_na, season)
    wide = tail_means(sample, DEPTH_KEYS, "Sum_Precip", PROBS, TAIL_NAMES, empty, _to_neighbours)
    if limit is not None:
        wide = wide.where(F.abs("Sum_Press_Delta") < limit)
    return unpivot_quantiles(wide, DEPTH_KEYS, TAIL_NAMES).withColumn(
        "Sum_Press_C", epc_band("Sum_Press_Delta", edges)
    )


def depth_quantile_surface(events: DataFrame) -> DataFrame:
    sample = depth_sample(events, None).drop("Season")
    keys = ["MonT", "Sum_Press_Delta"]
    wide = exact_quantiles(sample, keys, "Sum_Precip", SURFACE_PROBS, SURFACE_NAMES)
    return unpivot_quantiles(wide, keys, SURFACE_NAMES)


def season_overlay(df: DataFrame, label: str = "All Season") -> DataFrame:
    """The rows once more under one common season label."""
    return df.unionByName(df.withColumn("Season", F.lit(label)))


def extreme_events(events: DataFrame, prob: float = 0.95) -> DataFrame:
    """Events deeper than the quantile over all events of all stations."""
    cut = exact_quantiles(events, [], "Sum_Precip", [prob], ["q"])
    return events.where(F.col("Sum_Precip") > cut.scalar())


def tail_sample_size(
    events: DataFrame, side: str = "Jul ~ Dec", below: float = -3, kind: str = "InPCE", amt_step: float = 0.2
) -> DataFrame:
    amt = round_step("MonT", amt_step)
    return (
        events.select(half_year("Mon").alias("side"), amt.alias("MonT"), pce_type("Sum_Press_Delta").alias("PCEType"))
        .where((F.col("side") == side) & (F.col("MonT") < below) & (F.col("PCEType") == kind))
        .groupBy("PCEType", "MonT")
        .agg(F.count("*").alias("n"))
    )


def tail_sample_size_fanned(events: DataFrame, above_epc: float = 500, above_amt: float = 22) -> DataFrame:
    sample = neighbour_fanout(depth_sample(events, None, "month"), FANOUT)
    return (
        sample.where((F.col("Sum_Press_Delta") > above_epc) & (F.col("MonT") > above_amt))
        .groupBy("Season", "MonT")
        .agg(F.count("*").alias("n"))
    )


def event_scatter(events: DataFrame, by: str = "epc") -> DataFrame:
    """Points behind the depth scatter plots."""
    if by == "epc":
        return events.where(F.col("Sum_Precip") > 0).select("Sum_Press_Delta", "Sum_Precip")
    return events.where(F.col("Sum_Precip") > 0.01).select(
        "MonT",
        "Sum_Precip",
        F.when(F.col("MonT") < 12, F.lit("Winter")).otherwise(F.lit("Summer")).alias("YrSide"),
        pce_type("Sum_Press_Delta").alias("PCEType"),
    )


def case_study(series: DataFrame, station: str, start: str, end: str) -> DataFrame:
    """Rows of one station within a closed time range."""
    return series.where(
        (F.col(STATION) == station) & F.col(TIME).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    )


def with_week(df: DataFrame) -> DataFrame:
    return df.withColumns({"Yr": F.year(TIME), "Mon": F.month(TIME), "Wk": week_of_year(TIME)})
