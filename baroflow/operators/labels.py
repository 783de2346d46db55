"""Segmentation of a regular series into rain/dry events and pressure-change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from baroflow.operators.blocks import add_block_offsets, block_window, owned, with_halo
from baroflow.operators.smooth import change_of_runs, mean_span, run_sum, shifted_sum
from baroflow.schema import BLOCK, BLOCK_STEPS, STATION, TIME

LABELS = ("Evt_lab", "Press_Evt_lab")


def rain_flags(w, inter_event: int = 4, rule: str = "A") -> dict[str, Column]:
    """0/1 starts ``StR`` and ``StD`` from a gap-free ``Rain`` column, inside halo blocks.

    Rule A: rain starts after ``inter_event + 1`` rain-free steps, and a dry spell starts
    when that many rain-free steps lie ahead.  Rule B leaves the current step out of both
    sums, so one dry step fewer separates events.  A window cut off by the series end
    sums to zero.
    """
    rain, n, none = F.col("Rain"), inter_event, F.lit(0.0)
    before = F.lag("Rain", 1).over(w)

    def total(first: int, last: int) -> Column:
        return F.coalesce(shifted_sum("Rain", range(first, last + 1), w), none)

    if rule == "A":
        starts = before.isNotNull() & (total(-n - 1, -1) == 0) & (rain > 0)
        dries = (total(-1, n - 1) > 0) & (total(0, n) == 0) & (rain == 0)
    elif rule == "B":
        starts = (total(-n, 0) - rain == 0) & (rain > 0)
        dries = (total(-1, n - 1) - before == 0) & (before > 0)
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return {"StR": F.coalesce(starts.cast("int"), F.lit(0)), "StD": F.coalesce(dries.cast("int"), F.lit(0))}


def rain_halo(inter_event: int) -> tuple[int, int]:
    return inter_event + 1, inter_event


def pressure_flag(w) -> dict[str, Column]:
    """0/1 ``press_start``: the pressure change reaches or crosses zero from a non-zero value."""
    p, before = F.col("pressure_chng_av"), F.lag("pressure_chng_av").over(w)
    # Same sign test as a product, without underflow.
    turned = (F.signum(p) * F.signum(before) <= 0) & (before != 0)
    return {"press_start": F.coalesce(turned.cast("int"), F.lit(0))}


def _known_rain(df: DataFrame) -> DataFrame:
    return df.withColumn("Rain", F.coalesce("Rain", F.lit(0.0)))


def _running_in_block(df: DataFrame, labels: dict) -> DataFrame:
    w = block_window().rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({name: F.sum(flag.cast("long")).over(w) for name, flag in labels.items()})


def label_rain_dry(
    series: DataFrame, inter_event: int = 4, rule: str = "A", block_steps: int = BLOCK_STEPS
) -> DataFrame:
    """Adds ``StR, StD, Evt_lab``; the label counts all starts so far."""
    h = with_halo(_known_rain(series), *rain_halo(inter_event), size=block_steps)
    flagged = owned(h.withColumns(rain_flags(block_window(), inter_event, rule)))
    local = _running_in_block(flagged, {"Evt_lab": F.col("StR") + F.col("StD")})
    return add_block_offsets(local, ["Evt_lab"]).drop(BLOCK)


def label_pressure_events(series: DataFrame, block_steps: int = BLOCK_STEPS) -> DataFrame:
    """Adds ``Mon, Press_Evt_lab`` from ``pressure_chng_av``."""
    h = with_halo(series, 1, 0, size=block_steps)
    flagged = owned(h.withColumns(pressure_flag(block_window())))
    local = _running_in_block(flagged, {"Press_Evt_lab": F.col("press_start")})
    out = add_block_offsets(local, ["Press_Evt_lab"]).drop(BLOCK, "press_start")
    return out.withColumn("Mon", F.month(TIME))


def smooth_and_label(
    filled: DataFrame,
    n: int = 24,
    lag: int = 24,
    inter_event: int = 4,
    rule: str = "A",
    block_steps: int = BLOCK_STEPS,
) -> DataFrame:
    """All bounded frames of the curation in one pass over halo blocks.

    Expects the padded series with ``pressure_spl``; the result still carries the block
    and per-block label counts, to be completed by ``complete_labels``.
    """
    left, right = mean_span(n)
    rain_before, rain_after = rain_halo(inter_event)
    before, after = max(left + lag + 1, rain_before), max(right, rain_after)
    h = with_halo(_known_rain(filled), before, after, size=block_steps)
    w = block_window()
    h = h.withColumns({**rain_flags(w, inter_event, rule), "_run": run_sum("pressure_spl", n, w)})
    h = h.withColumns(change_of_runs("_run", n, lag, w)).withColumns(pressure_flag(w))
    return _running_in_block(
        owned(h), {"Evt_lab": F.col("StR") + F.col("StD"), "Press_Evt_lab": F.col("press_start")}
    ).drop("press_start", "_run")


def block_totals(local: DataFrame) -> DataFrame:
    """Labels that start in each block: one row per station and block."""
    return local.groupBy(STATION, BLOCK).agg(*[F.max(c).alias(c) for c in LABELS])


def complete_labels(local: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    return add_block_offsets(local, LABELS, totals=totals).drop(BLOCK)

