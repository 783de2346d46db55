"""Event tables: rain, dry and pressure-change events, and their overlap with data gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baroflow.functions.dates import step_micros
from baroflow.functions.nulls import snap
from baroflow.operators.blocks import block_of, explode_range, neighbour_rows
from baroflow.schema import STATION, STEP, TIME

LABEL_BLOCK = 4096  # events handled together when looking at the previous event
POOLED_BLOCK = 3600 * 1_000_000  # one hour of starts over all stations, in microseconds
OVERLAP_STEPS = 720  # width of the time buckets of the interval join


def last_labels(df: DataFrame, label: str) -> DataFrame:
    """The highest label of each station."""
    return df.groupBy(STATION).agg(F.max(label).alias(label))


def drop_last_label(df: DataFrame, label: str, of: DataFrame | None = None) -> DataFrame:
    """Rows except those of the station's highest label, found in ``of`` (default ``df``).

    Matched on station and label, which spreads a large station over all tasks.
    """
    return df.join(last_labels(df if of is None else of, label), [STATION, label], "left_anti")


def previous_event(
    df: DataFrame, label: str, columns: dict[str, str], across_stations: bool = False
) -> DataFrame:
    """Add values of the previous event; ``columns`` maps output to input.

    Previous means by label within the station, or by start time over all stations
    together (equal starts by label, then station).
    """
    pack = F.struct(*[F.col(src).alias(out) for out, src in columns.items()])
    if across_stations:
        timed = df.withColumn("_t", F.unix_micros("St"))
        out = neighbour_rows(
            timed, previous={"_before": (pack, None)}, keys=[], order="_t", size=POOLED_BLOCK, ties=[label, STATION]
        ).drop("_t")
    else:
        out = neighbour_rows(df, previous={"_before": (pack, None)}, order=label, size=LABEL_BLOCK)
    return out.withColumns({c: F.col(f"_before.{c}") for c in columns}).drop("_before")


# -- rain and dry events ------------------------------------------------------------


def spell_parts(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mergeable totals per station and rain/dry label, label 0 included.

    With labels that count within blocks, ``keys`` names the block; offsets are then added to
    these few rows instead of the series.
    """
    return rows.groupBy(STATION, *keys, "Evt_lab").agg(
        F.min(TIME).alias("t0"),
        F.max(TIME).alias("t1"),
        F.sum("Rain").alias("rain"),
        F.max("Rain").alias("peak"),
        F.min(STEP).alias("s0"),
        F.max(STEP).alias("s1"),
    )


def _spells(parts: DataFrame, step_minutes: int) -> DataFrame:
    return (
        parts.where(F.col("Evt_lab") > 0)
        .groupBy(STATION, "Evt_lab")
        .agg(
            F.min("t0").alias("Start"),
            F.max("t1").alias("End"),
            (F.rint(F.sum("rain") * 1000.0) / 1000.0).alias("TotalRain"),
            F.max("peak").alias("Max_Intensity"),
            ((F.max("s1") - F.min("s0") + 1) * (step_minutes / 60.0)).alias("Dur_hr"),
        )
    )


def rain_spells(parts: DataFrame, step_minutes: int = 60) -> DataFrame:
    """Wet events from ``spell_parts``; the last label of a station is unfinished and left out."""
    spells = drop_last_label(_spells(parts, step_minutes), "Evt_lab")
    return previous_event(spells, "Evt_lab", {"PreDry_Dur_hr": "Dur_hr"}).where(F.col("TotalRain") > 0)


def dry_spells(parts: DataFrame, step_minutes: int = 60) -> DataFrame:
    """Dry events from ``spell_parts``; the last label is kept."""
    spells = _spells(parts, step_minutes)
    return previous_event(spells, "Evt_lab", {"PreRain_Dur_hr": "Dur_hr"}).where(F.col("TotalRain") == 0)


def rain_events(labelled: DataFrame, step_minutes: int = 60) -> DataFrame:
    """Wet events of a labelled series."""
    return rain_spells(spell_parts(labelled), step_minutes)


def dry_events(labelled: DataFrame, step_minutes: int = 60) -> DataFrame:
    """Dry events of a labelled series."""
    return dry_spells(spell_parts(labelled), step_minutes)


# -- pressure-change events -----------------------------------------------------------


def event_parts(labelled: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mergeable sums per station, event and calendar month.

    The one aggregate over the full series: events, monthly temperatures and the second
    pass after gap removal are all small aggregates of this table. ``keys`` as in ``spell_parts``.
    """
    chng = F.col("pressure_chng_av")
    return labelled.groupBy(
        STATION, *keys, "Press_Evt_lab", F.year(TIME).alias("Yr"), F.month(TIME).alias("Mon")
    ).agg(
        F.min(STEP).alias("s0"),
        F.max(STEP).alias("s1"),
        F.min(TIME).alias("t0"),
        F.max(TIME).alias("t1"),
        F.sum(chng).alias("chng"),
        F.count_if(chng.isNull()).alias("chng_na"),
        F.count_if(F.col("Pressure_hPa").isNull()).alias("press_na"),
        F.count_if(F.col("Temp_C").isNull()).alias("temp_na"),
        F.sum("Rain").alias("rain"),
        F.sum("StR").alias("st_rain"),
        F.sum("StD").alias("st_dry"),
        F.sum("Temp_C").alias("temp"),
        F.count("Temp_C").alias("temp_n"),
    )


def _month_mean(parts: DataFrame, pooled: bool) -> DataFrame:
    keys = ["Yr", "Mon"] if pooled else [STATION, "Yr", "Mon"]
    total, n = F.sum("temp"), F.sum("temp_n")
    return parts.groupBy(*keys).agg(snap(F.when(n > 0, total / n)).alias("MonT"))


def monthly_temp(labelled: DataFrame, pooled: bool = False) -> DataFrame:
    """Average monthly temperature (AMT), by station or pooled over all stations."""
    keys = ["Yr", "Mon"] if pooled else [STATION, "Yr", "Mon"]
    return (
        labelled.select(STATION, F.year(TIME).alias("Yr"), F.month(TIME).alias("Mon"), "Temp_C")
        .groupBy(*keys)
        .agg(snap(F.avg("Temp_C")).alias("MonT"))
    )


def merge_parts(parts: DataFrame) -> DataFrame:
    """One row per event label, label 0 included."""
    return parts.groupBy(STATION, "Press_Evt_lab").agg(
        F.min("t0").alias("St"),
        F.max("t1").alias("End"),
        (F.max("s1") - F.min("s0") + 1).cast("double").alias("Dur"),
        snap(F.when(F.sum("chng_na") == 0, F.sum("chng"))).alias("Sum_Press_Delta"),
        F.sum("press_na").alias("Press_NA"),
        F.sum("temp_na").alias("Temp_NA"),
        snap(F.sum("rain")).alias("Sum_Precip"),
        F.sum("st_rain").alias("St_Rain"),
        F.sum("st_dry").alias("St_Dry"),
    )


def pressure_events(
    parts: DataFrame,
    max_dur: float = 1000,
    pooled_temp: bool = False,
    lags: bool = True,
    pooled_lags: bool = False,
) -> DataFrame:
    """Pressure-change events from ``event_parts``.

    Label 0 (before the first turn) and the last label of each station are no events,
    nor are runs of ``max_dur`` steps or more.  ``Dur`` counts grid steps, which are hours
    on the hourly grid.
    """
    merged = drop_last_label(merge_parts(parts), "Press_Evt_lab")
    events = (
        merged.where((F.col("Press_Evt_lab") > 0) & (F.col("Dur") < max_dur))
        .withColumns({"Yr": F.year("St"), "Mon": F.month("St")})
    )
    months = _month_mean(parts, pooled_temp)
    keys = ["Yr", "Mon"] if pooled_temp else [STATION, "Yr", "Mon"]
    events = events.join(months, keys, "left")
    if lags:
        events = previous_event(
            events,
            "Press_Evt_lab",
            {"Dur_lag1": "Dur", "Press_Delta_lag1": "Sum_Press_Delta"},
            pooled_lags,
        )
    return events


# -- gaps ---------------------------------------------------------------------------


def overlap_join(
    gaps: DataFrame, events: DataFrame, step_minutes: int = 60, bucket_steps: int = OVERLAP_STEPS
) -> DataFrame:
    """Pairs of a gap and an event of the same station that share at least one instant.

    Both ends are closed.  Intervals are spread over time buckets and matched by station
    and bucket; a pair is kept only in the bucket where its common part begins, so no
    de-duplication is needed.
    """
    width = step_micros(step_minutes) * bucket_steps

    def spread(df: DataFrame, start: str, end: str) -> DataFrame:
        return explode_range(
            df, block_of(F.unix_micros(start), width), block_of(F.unix_micros(end), width), "_bucket"
        )

    g = spread(gaps.select(STATION, F.col("St").alias("gap_St"), F.col("End").alias("gap_End"), "TimeLag_min"),
               "gap_St", "gap_End")
    e = spread(events, "St", "End")
    common = F.greatest(F.col("gap_St"), F.col("St"))
    return (
        g.join(e, [STATION, "_bucket"])
        .where((F.col("gap_St") <= F.col("End")) & (F.col("gap_End") >= F.col("St")))
        .where(F.col("_bucket") == block_of(F.unix_micros(common), width))
        .drop("_bucket")
    )


def overlapped_labels(gaps: DataFrame, parts: DataFrame, step_minutes: int = 60, max_dur: float = 1000) -> DataFrame:
    """Labels of the events that touch a gap."""
    events = pressure_events(parts, max_dur, lags=False).select(STATION, "Press_Evt_lab", "St", "End")
    return overlap_join(gaps, events, step_minutes).select(STATION, "Press_Evt_lab").distinct()


def remove_gap_events(rows: DataFrame, overlapped: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """Drop rows (series rows or parts) of overlapped events, then the last remaining label.

    ``last`` may name a smaller table of the same labels to find the last one from.
    """
    label, keys = "Press_Evt_lab", [STATION, "Press_Evt_lab"]
    kept = (rows if last is None else last).select(keys).join(overlapped, keys, "left_anti")
    return rows.join(overlapped.unionByName(last_labels(kept, label)), keys, "left_anti")
