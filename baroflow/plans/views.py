"""Station views over the general-purpose test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from baroflow.functions.nulls import snap
from baroflow.schema import MEASURES, STATION, TIME


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(df: DataFrame, station: Column, time: Column, measures: list[Column]) -> DataFrame:
    return df.select(
        station.alias(STATION),
        time.cast("timestamp").alias(TIME),
        *[m.cast("double").alias(n) for n, m in zip(MEASURES, measures)],
    )


def hourly_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as station readings."""
    v, u = F.col("value"), F.col("user_id")
    return _view(
        table(spark, sf_dir, "events"),
        F.concat_ws("-", "event_type", (u % 2).cast("string")),
        F.col("ts"),
        [F.greatest(v - 100, F.lit(0.0)), 1000 + v % 40, v % 35, v % 35 - u % 10, v % 100, u % 20],
    )


def daily_readings(spark: SparkSession, sf_dir: str, per_supplier: bool = False) -> DataFrame:
    """``lineitem`` as daily station readings, by supplier group or by supplier."""
    supp = F.col("l_suppkey") if per_supplier else F.col("l_suppkey") % 10
    temp = 10 * F.sin(F.dayofyear("l_shipdate") / 58.1) + 100 * F.col("l_discount")
    q = F.col("l_quantity")
    return _view(
        table(spark, sf_dir, "lineitem"),
        F.concat_ws("-", "l_returnflag", supp.cast("string")),
        F.col("l_shipdate"),
        [
            F.greatest(q - 45, F.lit(0.0)),
            990 + q,
            temp,
            temp - F.col("l_tax") * 100,
            50 + q,
            F.col("l_linenumber"),
        ],
    )


def cmi_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weekly index per station from ``lineitem``, dated on Mondays at midnight."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.concat_ws("-", "l_returnflag", (F.col("l_suppkey") % 10).cast("string")).alias("location"),
            F.date_trunc("week", F.col("l_shipdate").cast("timestamp")).alias("ymd_hms"),
        )
        .agg(snap(F.avg("l_tax") * 100 - 4, 6).alias("CMI"))
    )
