"""Hourly station CSV files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from baroflow.schema import MEASURES, STATION, TIME

# Spelling of the rain column in the two kinds of source file.
NCEI_RAIN = "Precip_mm"
FAWN_RAIN = "Pecipit_mm"


def number(name: str) -> Column:
    """Text to double; empty, ``NA`` and ``NaN`` become NULL."""
    v = F.col(name).try_cast("double")
    return F.when(~F.isnan(v), v)


def text_time(name: str) -> Column:
    """Year-month-day hour:minute:second text, in UTC."""
    return F.coalesce(
        F.try_to_timestamp(name, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(F.col(name))
    )


def read_station_csv(
    spark: SparkSession, path: str | list[str], rain_col: str = NCEI_RAIN, extra: tuple[str, ...] = ()
) -> DataFrame:
    """Readings of a header CSV, columns found by name; no type inference pass."""
    raw = spark.read.option("header", True).csv(path)
    names = {m: (rain_col if m == "Rain" else m) for m in MEASURES}
    return raw.select(
        text_time(TIME).alias(TIME),
        F.col(STATION),
        *[number(src).alias(m) for m, src in names.items()],
        *[number(c).alias(c) for c in extra],
    )


def union_sources(*sources: DataFrame) -> DataFrame:
    """All rows of all sources by column name; columns a source lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
