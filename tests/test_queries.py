"""Every registered query against its SQL, and what its plan may contain."""

import duckdb
import pytest

import __spark_entry__ as entry
from lakeops import checks
from tools.compare import TABLES, rows_of

PYTHON_NODES = ("MapInPandas", "ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas", "MapInArrow")

# Queries whose work is a per-document or per-object function of the caller.
WITH_PYTHON = {
    "u1_parse_documents", "so2_union_outcomes", "w6_item_ordinals", "g2_parse_counters", "u2_inflate_objects",
    "u3_convert_studies", "s8_object_listing",
}


@pytest.fixture(scope="module")
def db(request):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    return connection


@pytest.mark.parametrize("key", list(checks.QUERIES))
def test_query(spark, db, sf, key):
    df = entry.queries()[key](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert key in WITH_PYTHON or not any(node in plan for node in PYTHON_NODES)
    want = db.sql(entry.oracle_sql()[key])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_windows_prune_partitions_and_columns(spark, sf):
    df = entry.queries()["s3_partition_window"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "dte_of_message" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert "ReadSchema: struct<hl7_id:string,observation_value_base64:string>" in plan
    listed = entry.queries()["s4_list_partitions"](spark, sf)
    assert "ReadSchema: struct<>" in listed._jdf.queryExecution().executedPlan().toString()


def test_day_filters_reach_the_scan(spark, sf):
    plan = entry.queries()["s9_daily_slice"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts," in plan and "LessThan(ts," in plan
