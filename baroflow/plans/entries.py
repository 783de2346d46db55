"""The three analyses from end to end."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from baroflow.operators import drought
from baroflow.plans.curation import Curated, Settings
from baroflow.plans.staging import stage


def pressure_change_events(readings: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Readings to pressure-change events clear of data gaps."""
    return Curated(readings, settings).events


def with_cmi(
    readings: DataFrame, cmi: DataFrame, settings: Settings = Settings(), shift: str = "calendar"
) -> Curated:
    """Curation of readings joined with the index of their week and of another week."""
    joined = drought.join_cmi_shift(drought.join_cmi(readings, cmi), cmi, shift)
    return Curated(joined, replace(settings, measures=(*settings.measures, "CMI", "CMI_pre")))


def weekly_drought(
    readings: DataFrame,
    cmi: DataFrame,
    settings: Settings = Settings(),
    shift: str = "calendar",
    start: str | None = None,
    end: str | None = None,
    below: float = -1,
) -> DataFrame:
    """Weeks whose standardised moisture index is under ``below``, with their weekly sums."""
    series = with_cmi(readings, cmi, settings, shift).gap_free_series
    return drought.zscore_filter(stage(drought.weekly_cmi(series, start, end), "weeks"), below=below)


def weekly_precipitation_index(
    readings: DataFrame,
    settings: Settings = Settings(),
    days: int = 30,
    years: tuple[int, int] | None = (1965, 2015),
    pooled: bool = False,
) -> DataFrame:
    """Readings to the weekly summary of the daily standardised precipitation index."""
    daily = stage(drought.daily_agg(Curated(readings, settings).gap_free_series), "daily")
    spi = drought.spi_daily(daily, days, years, pooled)
    return drought.weekly_spi(drought.join_spi_daily(spi, daily))
