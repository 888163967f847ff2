"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeops.checks import fixtures as fx
from lakeops.checks.base import query, table
from lakeops.operators import quality as q
from lakeops.operators.cohort import build_index

_SNAP = ("snap_source", "snap_destination")


@query("q1_equal_counts", """
    SELECT event_type AS dataset, d.n AS lhs, s.n AS rhs, d.n = s.n AS passed
    FROM (SELECT event_type, count(*) AS n FROM snap_source GROUP BY 1) s
    JOIN (SELECT event_type, count(*) AS n FROM snap_destination GROUP BY 1) d USING (event_type)
""", _SNAP)
def q1_equal_counts(spark, sf):
    return q.equal_counts(*fx.snapshots(spark, sf), "event_type")


def _growth(sign):
    return f"""
    SELECT event_type AS dataset, n AS lhs, before AS rhs, n {sign} before AS passed
    FROM (SELECT event_type, day, n, lag(n) OVER w AS before, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS r
          FROM (SELECT event_type, day, count(*) AS n FROM snap_source GROUP BY ALL) WINDOW w AS (PARTITION BY event_type ORDER BY day))
    WHERE r = 1
"""


@query("q2_greater_partition_counts", _growth(">"), _SNAP)
def q2_greater_partition_counts(spark, sf):
    return q.greater_partition_counts(fx.snapshots(spark, sf)[0], "event_type", "day")


@query("q3_greater_or_equal_partition_counts", _growth(">="), _SNAP)
def q3_greater_or_equal_partition_counts(spark, sf):
    return q.greater_or_equal_partition_counts(fx.snapshots(spark, sf)[0], "event_type", "day")


_NULLS = "\nUNION ALL ".join(
    f"SELECT event_type, '{c}' AS col, count(*) FILTER ({c} IS NULL) AS n FROM TABLE_ GROUP BY 1"
    for c in ("event_id", "ts", "user_id", "value", "props", "day")
)


@query("q4_lower_or_equal_null_counts", f"""
    SELECT event_type AS dataset, col AS "column", d.n AS lhs, s.n AS rhs, d.n <= s.n AS passed
    FROM ({_NULLS.replace('TABLE_', 'snap_source')}) s JOIN ({_NULLS.replace('TABLE_', 'snap_destination')}) d USING (event_type, col)
""", _SNAP)
def q4_lower_or_equal_null_counts(spark, sf):
    return q.lower_or_equal_null_counts(*fx.snapshots(spark, sf), "event_type")


def _index(spark, sf):
    return build_index(table(spark, sf, "customer"), "c_custkey", "k")


def _damaged(spark, sf):
    """The index with one nation's keys mapped to one id, another's listed twice, a third's missing."""
    index = _index(spark, sf).join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    shared = index.withColumn("index_id", F.when(F.col("c_nationkey") == 3, "same").otherwise(F.col("index_id")))
    return shared.where("c_nationkey <> 4").unionByName(shared.where("c_nationkey = 5")).drop("c_nationkey")


@query("q5_index_valid_mapping", """
    SELECT 'index' AS dataset, CAST(0 AS BIGINT) AS lhs, CAST(0 AS BIGINT) AS rhs, true AS passed
    UNION ALL
    SELECT 'damaged', 0, CASE WHEN count(*) > 1 THEN 1 ELSE 0 END, count(*) <= 1 FROM customer WHERE c_nationkey = 3
""")
def q5_index_valid_mapping(spark, sf):
    return q.index_valid_mapping(_index(spark, sf), "c_custkey", "index_id", "index").unionByName(
        q.index_valid_mapping(_damaged(spark, sf), "c_custkey", "index_id", "damaged")
    )


@query("q6_index_valid_occurrences", """
    SELECT 'index' AS dataset, CAST(0 AS BIGINT) AS lhs, CAST(0 AS BIGINT) AS rhs, true AS passed
    UNION ALL SELECT 'damaged', count(*), 0, count(*) = 0 FROM customer WHERE c_nationkey IN (4, 5)
""")
def q6_index_valid_occurrences(spark, sf):
    customers = table(spark, sf, "customer")
    return q.index_valid_occurrences(_index(spark, sf), customers, "c_custkey", "index").unionByName(
        q.index_valid_occurrences(_damaged(spark, sf), customers, "c_custkey", "damaged")
    )


@query("q7_index_greater_or_equal", """
    SELECT 'grown' AS dataset, count(*) AS lhs, count(*) FILTER (c_nationkey <> 7) AS rhs, true AS passed FROM customer
    UNION ALL SELECT 'shrunk', count(*) FILTER (c_nationkey <> 7), count(*), count(*) FILTER (c_nationkey <> 7) >= count(*) FROM customer
""")
def q7_index_greater_or_equal(spark, sf):
    now = _index(spark, sf)
    previous = build_index(table(spark, sf, "customer").where("c_nationkey <> 7"), "c_custkey", "k")
    return q.index_greater_or_equal(now, previous, "grown").unionByName(q.index_greater_or_equal(previous, now, "shrunk"))
