"""From readings to pressure-change events free of data gaps."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baroflow.operators.blocks import add_block_offsets
from baroflow.operators.events import (
    event_parts,
    overlapped_labels,
    pressure_events,
    remove_gap_events,
    spell_parts,
)
from baroflow.operators.grid import bucket_mean, gap_table, with_time
from baroflow.operators.labels import LABELS, block_totals, complete_labels, smooth_and_label
from baroflow.operators.smooth import fill_and_pad
from baroflow.plans.staging import stage
from baroflow.schema import BLOCK, BLOCK_STEPS, MEASURES, STATION


@dataclass(frozen=True)
class Settings:
    """Rules of the curation; the defaults are for hourly data."""

    step_minutes: int = 60
    gap_min: float = 240
    recurrent: tuple[float, float, int] | None = (60, 240, 100)
    fill: str = "spline"
    mean_steps: int = 24
    lag_steps: int = 24
    inter_event: int = 4
    rule: str = "A"
    max_dur: float = 1000
    pooled_temp: bool = False
    pooled_lags: bool = False
    measures: Sequence[str] = tuple(MEASURES)
    block_steps: int = BLOCK_STEPS


# Daily data: the band of the recurrent-gap rule restated in days; that rule is off by
# default here, since a day without a reading is no fault of a daily record.
DAILY_RECURRENT = (1440, 4 * 1440, 100)
DAILY = Settings(step_minutes=1440, gap_min=4 * 1440, recurrent=None)


class Curated:
    """Tables of one curation run.

    Readings are scanned once into staged step means; the labelled series is computed
    once and staged.  Everything else is a small aggregate of those two tables, built on
    first use.
    """

    def __init__(self, readings: DataFrame, settings: Settings = Settings()):
        self.settings = settings
        self.buckets = stage(bucket_mean(readings, settings.step_minutes, settings.measures), "buckets")
        self._memo: dict = {}

    def _once(self, name, build):
        if name not in self._memo:
            self._memo[name] = build()
        return self._memo[name]

    @property
    def filled(self) -> DataFrame:
        s = self.settings
        grid = fill_and_pad(self.buckets, s.fill, measures=list(s.measures), block_steps=s.block_steps)
        return with_time(grid, s.step_minutes)

    @property
    def _local(self) -> DataFrame:
        """The staged series: smoothed pressure, and labels that count within each block."""
        s = self.settings
        return self._once(
            "local",
            lambda: stage(
                smooth_and_label(self.filled, s.mean_steps, s.lag_steps, s.inter_event, s.rule, s.block_steps),
                "labelled",
            ),
        )

    @property
    def _totals(self) -> DataFrame:
        return self._once("totals", lambda: stage(block_totals(self._local), "totals"))

    @property
    def series(self) -> DataFrame:
        """The regular series with smoothed pressure and event starts, for readers that need no label."""
        return self._local.drop(BLOCK, *LABELS)

    @property
    def labelled(self) -> DataFrame:
        """The regular series with smoothed pressure and both event labels."""
        return complete_labels(self._local, self._totals)

    @property
    def spells(self) -> DataFrame:
        """Mergeable totals of rain and dry spells; offsets meet these rows, not the series."""
        parts = spell_parts(self._local, [BLOCK])
        return add_block_offsets(parts, ["Evt_lab"], totals=self._totals).drop(BLOCK)

    @property
    def gaps(self) -> DataFrame:
        s = self.settings
        return gap_table(self.buckets, s.step_minutes, s.gap_min, s.recurrent, s.block_steps)

    @property
    def parts(self) -> DataFrame:
        """Mergeable sums per event and month, and per block, with the label within the block beside."""

        def build():
            local = event_parts(self._local, [BLOCK]).withColumn("local_lab", F.col("Press_Evt_lab"))
            return stage(add_block_offsets(local, ["Press_Evt_lab"], totals=self._totals), "parts")

        return self._once("parts", build)

    @property
    def events_before_gaps(self) -> DataFrame:
        return self._events(self.parts)

    def _events(self, parts: DataFrame) -> DataFrame:
        s = self.settings
        return pressure_events(parts, s.max_dur, s.pooled_temp, pooled_lags=s.pooled_lags)

    @property
    def overlapped(self) -> DataFrame:
        s = self.settings
        return self._once(
            "overlapped",
            lambda: stage(overlapped_labels(self.gaps, self.parts, s.step_minutes, s.max_dur), "overlapped"),
        )

    @property
    def gap_free_series(self) -> DataFrame:
        """The labelled series without overlapped events, in one join with the labels that stay."""
        labels = self.parts.select(STATION, BLOCK, "local_lab", "Press_Evt_lab").distinct()
        kept = add_block_offsets(
            remove_gap_events(labels, self.overlapped, self.parts).withColumn("Evt_lab", F.lit(0).cast("long")),
            ["Evt_lab"],
            totals=self._totals,
        ).withColumnRenamed("Evt_lab", "_before")
        rows = self._local.withColumnRenamed("Press_Evt_lab", "local_lab")
        joined = rows.join(kept, [STATION, BLOCK, "local_lab"])
        return joined.withColumn("Evt_lab", F.col("Evt_lab") + F.col("_before")).drop(BLOCK, "local_lab", "_before")

    @property
    def events(self) -> DataFrame:
        """Events of the gap-free series; monthly temperatures use gap-free rows only."""
        return self._events(remove_gap_events(self.parts, self.overlapped))
