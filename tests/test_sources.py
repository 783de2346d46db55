"""Readers, writers and the shared folder."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from baroflow import sources
from baroflow.operators.grid import bucket_mean
from baroflow.plans import staging
from baroflow.plans.entries import pressure_change_events, weekly_drought, weekly_precipitation_index
from baroflow.plans.curation import Settings
from tests.helpers import T0, random_readings, readings


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_station_csv(spark, tmp_path):
    a = write(
        tmp_path / "a.csv",
        "Time,Location,Pecipit_mm,Pressure_hPa,Temp_C,DewPt_C,RH,Wind_SP_m_s",
        "2012-01-04 16:00:00,X,0.5,1010,20,NA,50,1",
        "2012-01-04 17:00:00,X,NA,,NaN,3,50,1",
    )
    rows = sources.read_station_csv(spark, a, sources.station_csv.FAWN_RAIN).orderBy("Time").collect()
    assert rows[0].Rain == 0.5 and rows[0].DewPt_C is None and str(rows[0].Time) == "2012-01-04 16:00:00"
    assert rows[1].Rain is None and rows[1].Pressure_hPa is None and rows[1].Temp_C is None


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3,), (3,)], "x int")
    assert sorted(map(tuple, sources.union_sources(a, b).collect()), key=str) == [(1, 2), (3, None), (3, None)]


def isd_line(usaf, ncdc, hhmm, temp, slp, pr, amt, q, rhx):
    head = [usaf, ncdc, "19960828", hhmm, "4", "FM-15", "V02", temp, "1", "12.5", "1", slp, "1"]
    return ",".join([*head, pr, amt, " ", q, *[""] * 12, rhx, ""])


def test_isd_text(spark, tmp_path):
    good = isd_line("725030", "14732", "0051", " 20.5", "1012.3", "01", "2.5", "1", "80")
    write(tmp_path / "a.txt", "banner one", "USAF ,NCDC ,Date", good)
    write(
        tmp_path / "b.txt", "banner one", "banner two",
        isd_line("999999", "13739", "1200", "999.9", "9999.9", "01", "1.0", "6", "999"),
        isd_line("725090", "14739", "2359", "900", "9000", "06", "3.0", "1", "55"),
    )
    out = sources.isd_readings(sources.read_isd_text(spark, f"{tmp_path}/*.txt"), sources.station_table(spark))
    got = {r.Location: r for r in out.collect()}
    assert set(got) == {"NYC", "PHL", "BOS"}
    assert str(got["NYC"].Time) == "1996-08-28 00:51:00" and got["NYC"].Rain == 2.5 and got["NYC"].Temp_C == 20.5
    assert got["PHL"].Rain is None and got["PHL"].Temp_C is None and got["PHL"].Pressure_hPa is None and got["PHL"].RH is None
    assert got["BOS"].Rain is None and got["BOS"].Temp_C == 900.0 and got["BOS"].Pressure_hPa == 9000.0


def test_no_reading_or_line_is_lost_silently(spark, tmp_path):
    unknown = isd_line("A07355", "00241", "0051", "20.5", "1012.3", "01", "2.5", "1", "80")
    path = write(tmp_path / "a.txt", isd_line("725030", "14732", "0051", "20", "1012", "01", "2", "1", "80"), unknown)
    out = sources.isd_readings(sources.read_isd_text(spark, path), sources.station_table(spark))
    assert {r.Location for r in bucket_mean(out).collect()} == {"NYC", "A07355-241"}
    late = write(tmp_path / "b.txt", isd_line("725030", "14732", "2561", "20", "1012", "01", "2", "1", "80"))
    with pytest.raises(Exception, match="no time: 19960828 2561"):
        sources.isd_readings(sources.read_isd_text(spark, late), sources.station_table(spark)).collect()
    for row in ((None, "X"), (T0, None)):
        with pytest.raises(Exception, match="reading without"):
            bucket_mean(readings(spark, [(row[1], row[0], {"Rain": 1.0})])).collect()
    for layout in (1, 2):
        lines = spark.createDataFrame([("801", layout), ("  ", layout)], "value string, layout int")
        assert sources.parse_cmi_lines(lines.where("value = '  '")).count() == 0
        with pytest.raises(Exception, match="without a second token: 801"):
            sources.parse_cmi_lines(lines).collect()


def test_rejected_lines_are_listed_and_counted(spark, tmp_path):
    good = isd_line("725030", "14732", "0051", "20", "1012", "01", "2", "1", "80")
    broken = good.replace("19960828", "1996082")
    # Banners by position: a broken line behind them is a reject, a third banner too.
    write(tmp_path / "a.txt", "banner one", "USAF ,NCDC ,Date", good, broken, good, "")
    write(tmp_path / "b.txt", "banner one", "banner two", "banner three", good)
    write(tmp_path / "c.txt", good, good, broken)
    (tmp_path / "d.txt").write_text("")
    seen = Observation()
    rows = sources.read_isd_text(spark, f"{tmp_path}/*.txt", seen)
    assert len(rows.collect()) == 5 and seen.get["without_date"] == 7 and seen.get["lines"] == 12
    got = sources.isd_rejects(spark, f"{tmp_path}/*.txt").select(F.element_at(F.split("file", "/"), -1), "value")
    assert sorted(map(tuple, got.collect())) == [("a.txt", broken), ("b.txt", "banner three"), ("c.txt", broken)]
    assert sources.isd_rejects(spark, f"{tmp_path}/b.txt", banner_lines=3).count() == 0


def test_rejects_in_a_file_of_many_splits(spark, tmp_path):
    good = isd_line("725030", "14732", "0051", "20", "1012", "01", "2", "1", "80")
    broken = [good.replace("19960828", f"x{i}") for i in range(50)]
    lines = ["banner one", "banner two"]
    for b in broken:
        lines += [good] * 20 + [b]
    write(tmp_path / "a.txt", *lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = sources.isd_rejects(spark, str(tmp_path / "a.txt"))
        assert sorted(r.value for r in got.collect()) == sorted(broken)
        assert spark.read.text(str(tmp_path / "a.txt")).rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_counts_of_index_lines(spark, tmp_path):
    write(tmp_path / "palmer73.txt", " 80173 4 1.10 0.2.  3.10 0.20 1.50 0.80 0.90 2.00 ", "", " 4407312 0.10 7.  3.10 0.20 2.50 0.80 0.90 2.00 ")
    write(tmp_path / "palmer97.txt", " 801199753 0.10 7.  3.10 0.20 0.25 0.80 0.90 2.00 ", " 80119975399 0.10 7.  3.10 0.20 0.25 0.80 0.90 2.00 ")
    write(tmp_path / "other.txt", "a line", "another")
    files, parsed, dated = Observation(), Observation(), Observation()
    lines = sources.parse_cmi_lines(sources.read_cmi_text(spark, f"{tmp_path}/*.txt", files), parsed)
    rows = sources.station_records(lines, dated).collect()
    assert [(r.location, r.CMI) for r in rows] == [("PENSACOLA REGIONAL AIRPORT, FL US", "1.50")]
    assert files.get == {"lines": 7, "unknown_file": 2}
    assert parsed.get == {"parsed": 5, "blank": 1, "long_id": 1}
    assert dated.get == {"records": 3, "other_state": 1, "late_week": 1}


def test_index_csv(spark, tmp_path):
    path = write(tmp_path / "cmi.csv", "location,CMI,ymd_hms,more", "X,-1.25,1996-08-26 00:00:00,1", "Y,NA,1996-09-02 00:00:00,2", "Z,NaN,,3")
    rows = sources.read_cmi_csv(spark, path).orderBy("location").collect()
    assert [(str(r.ymd_hms), r.location, r.CMI) for r in rows] == [
        ("1996-08-26 00:00:00", "X", -1.25), ("1996-09-02 00:00:00", "Y", None), ("None", "Z", None)
    ]


def test_layout_follows_the_file_name(spark, tmp_path):
    for name in ("palmer73.txt", "palmer96a.txt", "palmer97.txt", "palmer01.txt", "palmer12.txt", "other.txt"):
        write(tmp_path / name, name)
    got = {r.value: r.layout for r in sources.read_cmi_text(spark, f"{tmp_path}/*.txt").collect()}
    assert got == {"palmer73.txt": 1, "palmer96a.txt": 1, "palmer97.txt": 2, "palmer01.txt": 2, "palmer12.txt": 2}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "Location string, x double")
    sources.write_csv(df, f"{tmp_path}/csv")
    assert sorted(map(tuple, spark.read.option("header", True).csv(f"{tmp_path}/csv").collect())) == [("a", "1.5"), ("b", None)]
    sources.write_events(df, f"{tmp_path}/ev")
    assert spark.read.parquet(f"{tmp_path}/ev").where(F.col("Location") == "a").count() == 1
    with pytest.raises(Exception, match="exist"):
        sources.write_csv(df, f"{tmp_path}/csv")


def test_stage_uses_the_named_folder(spark):
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert staging.shared_folder(spark) == folder.rstrip("/")
    out = staging.stage(spark.range(5), "t")
    assert out.count() == 5 and folder in out.inputFiles()[0]


def test_entries_run(spark):
    r = staging.stage(random_readings(spark, 2, 24 * 60, keep=0.97, holes=((200, 215),)), "readings")
    assert pressure_change_events(r).count() > 10
    cmi = r.select(F.col("Location").alias("location"), F.date_trunc("week", "Time").alias("ymd_hms")).distinct().withColumn(
        "CMI", (F.dayofyear("ymd_hms") % 5).cast("double") - 2
    )
    assert weekly_drought(r, cmi, Settings(), below=10).count() > 5
    out = weekly_precipitation_index(r, Settings(recurrent=None), days=3, years=None)
    assert {"spi_av", "pre_sum", "diff_T_D", "dew_band"} <= set(out.columns) and out.count() > 0
