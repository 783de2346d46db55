"""Registered queries on the smallest tables: against the SQL twins, and the shape of their plans."""

import os

import pytest

import __spark_entry__ as entry
from tools.check_oracles import TABLES, rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
SAMPLE = [
    "regularise_series", "gap_table", "pressure_events", "rain_events", "pop_by_epc", "tail_mean",
    "weekly_cmi", "interval_overlap_join", "join_cmi_shift", "cmi_parse", "linear_fill",
]


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["Evt_Press_chng", "RainProb", "samplesize"] and df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_twin(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    res = con.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in res.description], res.fetchall())
