"""Every registered query against its SQL, and the plans of the main ones."""

import duckdb
import pytest

import __spark_entry__ as entry
from checks import registry
from checks.compare import connect, difference

SMALL = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    with connect(SMALL) as connection:
        assert isinstance(connection, duckdb.DuckDBPyConnection)
        yield connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    text = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    _, problem = difference(df, con, ORACLES.get(name))
    assert problem == ""


def test_every_sql_has_a_query():
    assert QUERIES.keys() <= entry.queries().keys() and ORACLES.keys() <= entry.oracle_sql().keys()
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    df = entry.entry(spark)
    assert "dentro_limite" in df.columns and df.count() > 0


def plan(spark, name):
    return QUERIES[name](spark, SMALL)._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "rfid_today")
    assert "GreaterThanOrEqual(ts,2024-01-30T00:00)" in text
    assert "LessThan(ts,2024-01-31T00:00)" in text
    counts = plan(spark, "caregiver_dashboard")
    assert "ReadSchema: struct<ts:timestamp_ntz,props:string>" in counts


def test_latest_rows_are_cut_before_the_shuffle(spark):
    for name in ("geofence_status", "entity_overview", "segment_severity_share", "top_k_history"):
        assert "WindowGroupLimit" in plan(spark, name)
