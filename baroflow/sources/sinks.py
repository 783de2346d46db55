"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from baroflow.schema import STATION


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


def write_events(events: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Event table as Parquet, one folder per station so that station filters prune files."""
    events.write.mode(mode).partitionBy(STATION).parquet(path)
