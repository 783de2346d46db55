"""Irregular readings onto a regular time grid.

Step rule: a reading belongs to the grid step nearest to it, half-way cases to the
later one.  The rule is a choice of this package wherever the source of the data does
not say otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baroflow.functions.bins import GAP_EDGES, ceil_cut
from baroflow.functions.dates import grid_step, grid_time
from baroflow.functions.nulls import as_double
from baroflow.operators.blocks import explode_range, neighbour_rows
from baroflow.schema import BLOCK_STEPS, MEASURES, STATION, STEP, TIME

RAIN_LIMIT = 999.9


def clean_rain(x="Rain") -> Column:
    """Rain counts only when strictly between zero and the sentinel."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when((c > 0) & (c < RAIN_LIMIT), c)


def bucket_mean(
    readings: DataFrame, step_minutes: int = 60, measures: Sequence[str] = MEASURES
) -> DataFrame:
    """One row per station and occupied grid step with the mean of each measure.

    The rain mean is over wet readings only.  ``first_obs`` / ``last_obs`` keep the raw
    times, from which data gaps are found without a second pass over the readings.
    The aggregate combines on the map side, so a dense station shrinks before it moves.
    A reading without a station or a time is an error.
    """
    needed = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit(f"reading without {c}"))).alias(c)
    cols = {m: clean_rain(as_double(m)) if m == "Rain" else as_double(m) for m in measures}
    return (
        readings.withColumns({c: needed(c) for c in (STATION, TIME)})
        .select(STATION, TIME, grid_step(TIME, step_minutes).alias(STEP), *[c.alias(m) for m, c in cols.items()])
        .groupBy(STATION, STEP)
        .agg(
            *[F.avg(m).alias(m) for m in measures],
            F.min(TIME).alias("first_obs"),
            F.max(TIME).alias("last_obs"),
        )
    )


def with_time(df: DataFrame, step_minutes: int = 60) -> DataFrame:
    return df.withColumn(TIME, grid_time(STEP, step_minutes))


def explode_steps(linked: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Repeat each occupied step up to the one before ``next_step``; measures stay on the first."""
    out = explode_range(
        linked.withColumnRenamed(STEP, "_from"),
        F.col("_from"),
        F.coalesce(F.col("next_step") - 1, F.col("_from")),
        STEP,
    )
    here = F.col(STEP) == F.col("_from")
    return out.withColumns({m: F.when(here, F.col(m)) for m in measures}).drop("_from", "next_step")


def pad_steps(
    buckets: DataFrame, measures: Sequence[str] = MEASURES, block_steps: int = BLOCK_STEPS
) -> DataFrame:
    """Every grid step between a station's first and last reading, missing ones empty.

    Each occupied step yields itself and the empty steps up to the next occupied one,
    so neither a generated spine nor a join against it is needed.
    """
    linked = neighbour_rows(
        buckets.select(STATION, STEP, *measures),
        following={"next_step": (F.col(STEP), None)},
        size=block_steps,
    )
    return explode_steps(linked, measures)


def regularise(
    readings: DataFrame,
    step_minutes: int = 60,
    measures: Sequence[str] = MEASURES,
    block_steps: int = BLOCK_STEPS,
) -> DataFrame:
    """Regular series keyed by station and time, from irregular readings."""
    padded = pad_steps(bucket_mean(readings, step_minutes, measures), measures, block_steps)
    return with_time(padded, step_minutes).select(STATION, STEP, TIME, *measures)


# -- gaps in the raw readings -----------------------------------------------------


def reading_lags(
    buckets: DataFrame, step_minutes: int = 60, block_steps: int = BLOCK_STEPS
) -> DataFrame:
    """Time between the last reading of one occupied step and the first of the next."""
    linked = neighbour_rows(
        buckets.select(STATION, STEP, "first_obs", "last_obs"),
        previous={"St": (F.col("last_obs"), None)},
        size=block_steps,
    )
    return (
        linked.where(F.col("St").isNotNull())
        .withColumnRenamed("first_obs", "End")
        .withColumn("TimeLag_min", (F.unix_micros("End") - F.unix_micros("St")) / 6e7)
        .withColumn("Years", F.year("End"))
        .select(STATION, "St", "End", "TimeLag_min", "Years")
    )


def recurrent_lags(lags: DataFrame, low: float = 60, high: float = 240, more_than: int = 100) -> DataFrame:
    """Lags strictly inside ``(low, high)`` whose exact length recurs at the station."""
    inside = lags.where((F.col("TimeLag_min") > low) & (F.col("TimeLag_min") < high))
    common = (
        inside.groupBy(STATION, "TimeLag_min").agg(F.count("*").alias("_n")).where(F.col("_n") > more_than)
    )
    return inside.join(common.drop("_n"), [STATION, "TimeLag_min"], "left_semi")


def gap_table(
    buckets: DataFrame,
    step_minutes: int = 60,
    gap_min: float = 240,
    recurrent: tuple[float, float, int] | None = (60, 240, 100),
    block_steps: int = BLOCK_STEPS,
) -> DataFrame:
    """Long gaps plus shorter gaps whose length keeps recurring (unless ``recurrent`` is None).

    Two readings of the same step are less than one step apart, so every gap of at
    least a step shows between neighbouring occupied steps.
    """
    if gap_min < step_minutes or (recurrent and recurrent[0] < step_minutes):
        raise ValueError("gap lengths below one grid step cannot be told apart")
    lags = reading_lags(buckets, step_minutes, block_steps)
    cols = [STATION, "St", "End", "TimeLag_min", "Years"]
    long_gaps = lags.where(F.col("TimeLag_min") >= gap_min).select(cols)
    if not recurrent:
        return long_gaps
    return recurrent_lags(lags, *recurrent).select(cols).unionByName(long_gaps)


def gap_census(
    buckets: DataFrame, step_minutes: int = 60, measure: str = "Temp_C", block_steps: int = BLOCK_STEPS
) -> DataFrame:
    """Number of gaps (in hours) between non-missing values, by station and length band."""
    known = buckets.where(F.col(measure).isNotNull()).select(STATION, STEP)
    linked = neighbour_rows(known, following={"next_step": (F.col(STEP), None)}, size=block_steps)
    hours = (F.col("next_step") - F.col(STEP)) * (step_minutes / 60.0)
    labels = ["(0,1]", "(1,6]", "(6,24]", "(24,Inf]"]
    return (
        linked.select(STATION, ceil_cut(hours, GAP_EDGES, labels).alias("gp"))
        .groupBy(STATION, "gp")
        .agg(F.count("*").alias("n"))
    )
