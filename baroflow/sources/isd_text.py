"""Raw comma-separated station text: two banner lines per file, thirty unnamed fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from baroflow.schema import STATION, TIME
from baroflow.sources.rejects import counted

# Field names in file order.
FIELDS = (
    ["USAF", "NCDC", "Date", "HrMn", "I", "Type", "QCP"]
    + ["Temp", "Temp_Q", "DewPt", "DewPt_Q", "SLP", "SLP_Q"]
    + [f"Precip_{part}{hours}" for hours in (1, 6, 24, 99) for part in ("Pr", "Amt", "I", "Q")]
    + ["RHX"]
)
NUMERIC = ["Temp", "DewPt", "SLP", "RHX", *[f"Precip_Amt{h}" for h in (1, 6, 24, 99)]]
# Station identifiers and short names.
STATIONS = [
    (725090, 14739, "BOS"),
    (999999, 13739, "PHL"),
    (724080, 13739, "PHL"),
    (999999, 14732, "NYC"),
    (725030, 14732, "NYC"),
]
BAD_FLAGS = ["2", "3", "6", "7"]


BANNER_LINES = 2


def _no_date(date: Column) -> Column:
    return ~F.coalesce(date.rlike("^[0-9]{8}$"), F.lit(False))


def read_isd_text(spark: SparkSession, path: str | list[str], counts: Observation | None = None) -> DataFrame:
    """Data lines of every file; lines whose date field is not eight digits are left out.

    Those are the banner lines, and broken data lines: ``counts`` receives ``lines`` and
    ``without_date``, and ``isd_rejects`` lists the ones that are no banner.  Fields are read
    as text, so codes keep their leading zeros; station ids may hold letters and lose
    theirs. The trailing field is dropped.
    """
    schema = T.StructType([T.StructField(f, T.StringType()) for f in [*FIELDS, "_rest"]])
    raw = spark.read.schema(schema).option("ignoreLeadingWhiteSpace", True).option(
        "ignoreTrailingWhiteSpace", True
    ).csv(path)
    bad = _no_date(F.col("Date"))
    rows = counted(raw, counts, lines=F.lit(True), without_date=bad).where(~bad).drop("_rest")
    return rows.withColumns(
        {c: F.col(c).try_cast("double") for c in NUMERIC}
        | {c: F.regexp_replace(c, "^0+(?=.)", "") for c in ("USAF", "NCDC")}
    )


def isd_rejects(spark: SparkSession, path: str | list[str], banner_lines: int = BANNER_LINES) -> DataFrame:
    """Lines that ``read_isd_text`` leaves out and that are no banner: ``file, value``.

    A banner stands on the first ``banner_lines`` lines of its file.  The rows of a file's first
    split are numbered in file order, so that only the lines without a date, and one row a
    file, are joined.  Blank lines count as no line.
    """
    text = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    head = text.groupBy("file").agg(F.min(F.when(F.col("block") == 0, F.col("line"))).alias("first"))
    bad = text.where(_no_date(F.trim(F.get(F.split("value", ",", 4), F.lit(2)))) & (F.trim("value") != ""))
    late = (F.col("block") > 0) | (F.col("line") - F.col("first") >= banner_lines)
    return bad.join(head, "file").where(late).select("file", "value")


def station_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(str(a), str(b), name) for a, b, name in STATIONS], "USAF string, NCDC string, Location string")


def unite_time(df: DataFrame) -> DataFrame:
    """Date and hour-minute fields into one timestamp; fields that are no time are an error."""
    text = F.concat_ws(" ", "Date", F.lpad("HrMn", 4, "0"))
    time = F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyyMMdd HHmm")), F.raise_error(F.concat(F.lit("no time: "), text))
    )
    return df.withColumn(TIME, time).drop("Date", "HrMn")


def drop_suffixes(df: DataFrame, *suffixes: str) -> DataFrame:
    return df.select(*[c for c in df.columns if not c.endswith(suffixes)])


def clean_isd(df: DataFrame) -> DataFrame:
    """Sentinels to NULL; hourly rain only with period code 01 and no bad quality flag."""
    bad = F.coalesce(F.col("Precip_Q1").isin(BAD_FLAGS), F.lit(False))
    return df.withColumns(
        {
            "Temp": F.when(F.col("Temp") <= 900, F.col("Temp")),
            "DewPt": F.when(F.col("DewPt") <= 900, F.col("DewPt")),
            "SLP": F.when(F.col("SLP") <= 9000, F.col("SLP")),
            "RHX": F.when(F.col("RHX") <= 900, F.col("RHX")),
            "Precip_Amt1": F.when((F.col("Precip_Pr1") == "01") & ~bad, F.col("Precip_Amt1")),
        }
    )


def isd_readings(df: DataFrame, stations: DataFrame) -> DataFrame:
    """Cleaned readings with the station's short name and this package's column names.

    A station that the table does not know is named by its ids.
    """
    ids = F.nullif(F.concat_ws("-", "USAF", "NCDC"), F.lit(""))
    named = df.join(stations, ["USAF", "NCDC"], "left").withColumn(STATION, F.coalesce(STATION, ids))
    return unite_time(clean_isd(drop_suffixes(named, "6", "24", "99"))).select(
        STATION,
        TIME,
        F.col("Precip_Amt1").alias("Rain"),
        F.col("SLP").alias("Pressure_hPa"),
        F.col("Temp").alias("Temp_C"),
        F.col("DewPt").alias("DewPt_C"),
        F.col("RHX").alias("RH"),
        F.lit(None).cast("double").alias("Wind_SP_m_s"),
    )
