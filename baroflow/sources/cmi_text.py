"""Weekly crop-moisture-index text files, parsed with column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from baroflow.functions.dates import monday_of_week
from baroflow.sources.rejects import counted
from baroflow.sources.station_csv import number, text_time

# File-name patterns of the two line layouts.
LAYOUT_2 = "palmer(9[789]|[01])[^/]*[.]txt"
LAYOUT_1 = "palmer([78]|9[0123456])[^/]*[.]txt"
# State prefix, and district code to station name.
STATE_PREFIX = "^80"
DISTRICTS = {
    "801": "PENSACOLA REGIONAL AIRPORT, FL US",
    "802": "TALLAHASSEE REGIONAL AIRPORT, FL US",
    "803": "JACKSONVILLE INTERNATIONAL AIRPORT, FL US",
    "804": "ORLANDO INTERNATIONAL AIRPORT",
    "805": "TAMPA INTERNATIONAL AIRPORT, FL US",
    "806": "MIAMI INTERNATIONAL AIRPORT, FL US",
    "807": "Key West",
}


def read_cmi_text(spark: SparkSession, path: str | list[str], counts: Observation | None = None) -> DataFrame:
    """Lines with the layout that the file name tells; files of no known name are left out.

    ``counts`` receives ``lines`` and ``unknown_file`` (lines left out).
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    layout = F.when(F.col("file").rlike(LAYOUT_2), F.lit(2)).when(F.col("file").rlike(LAYOUT_1), F.lit(1))
    lines = lines.select("value", layout.alias("layout"))
    lines = counted(lines, counts, lines=F.lit(True), unknown_file=F.col("layout").isNull())
    return lines.where(F.col("layout").isNotNull())


def _tokens(text: Column, limit: int = -1) -> Column:
    return F.split(text, r"\s+", limit)


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def parse_cmi_lines(lines: DataFrame, counts: Observation | None = None) -> DataFrame:
    """``id`` and ``CMI`` of every line whose id has at most ten characters.

    A full stop followed by two blanks parts a line.  The index is the fourth token from
    the right end.  On the left, a one-digit week stands apart from the id and is glued
    on with a zero.  A line that is not blank but has no second token is an error.
    ``counts`` receives ``parsed``, ``blank`` and ``long_id`` (the latter two left out).
    """
    halves = F.split(_strip(F.col("value")), r"\.  ")
    left, right = F.element_at(halves, 1), _tokens(_strip(F.element_at(halves, -1)))
    cmi = F.element_at(right, F.greatest(F.size(right) - 3, F.lit(1)))
    three = _tokens(left, 3)
    two = _tokens(left, 2)
    second3, second2 = F.get(three, F.lit(1)), F.get(two, F.lit(1))
    newer = F.when(F.contains(second3, F.lit(".")), three[0]).otherwise(F.concat(three[0], F.lit("0"), second3))
    older = F.when(
        F.length(second2) > 8, F.concat(two[0], F.lit("0"), F.substring(second2, 1, 1))
    ).when(second2.isNotNull(), two[0])
    bad = F.raise_error(F.concat(F.lit("line without a second token: "), F.col("value")))
    ident = F.when(_strip(F.col("value")) != "", F.coalesce(F.when(F.col("layout") == 2, newer).otherwise(older), bad))
    out = lines.select(ident.alias("id"), cmi.alias("CMI"))
    out = counted(out, counts, parsed=F.lit(True), blank=F.col("id").isNull(), long_id=F.length("id") > 10)
    return out.where(F.length("id") <= 10)


def station_records(parsed: DataFrame, counts: Observation | None = None) -> DataFrame:
    """Dated index values of the stations of one state: ``ymd_hms, location, CMI``.

    Weeks above 52 are dropped.  A district missing from the table is an error.
    ``counts`` receives ``records`` (of all states), ``other_state`` and ``late_week`` (the latter
    two left out).
    """
    ident = F.col("id")
    code = F.substring(ident, 1, 3)
    names = F.create_map(*[F.lit(v) for pair in DISTRICTS.items() for v in pair])
    location = F.coalesce(
        F.try_element_at(names, code), F.raise_error(F.concat(F.lit("unknown district "), code))
    )
    stamp = F.when(F.length(ident) == 7, F.concat(F.lit("19"), F.right(ident, F.lit(4)))).otherwise(
        F.right(ident, F.lit(6))
    )
    own = ident.rlike(STATE_PREFIX)
    week = F.when(own, F.substring("_stamp", 5, 2)).cast("int")
    dated = parsed.withColumn("_stamp", stamp).withColumn("_week", week)
    dated = counted(dated, counts, records=F.lit(True), other_state=~own, late_week=F.col("_week") > 52)
    return (
        dated.where(F.col("_week") <= 52)
        .select(
            F.date_format(
                monday_of_week(F.substring("_stamp", 1, 4).cast("int"), F.col("_week")), "yyyy-MM-dd 00:00:00"
            ).alias("ymd_hms"),
            location.alias("location"),
            "CMI",
        )
    )


def read_cmi_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    return raw.select(text_time("ymd_hms").alias("ymd_hms"), "location", number("CMI").alias("CMI"))
