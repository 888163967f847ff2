"""Form and indicator queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeops.checks import fixtures as fx
from lakeops.checks.base import query, table
from lakeops.operators.cohort import new_forms
from lakeops.operators.forms import forms_wide, union_systems
from lakeops.operators.measures import (
    cents, duplicates, duration_days, lab_pairs, lab_statistics, period_pivot, weekly_summary,
)

_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"


def _pivot_sql():
    spans = range(1, 14)
    values = ", ".join(f"CAST(sum(v) FILTER (p = {i}) AS BIGINT) AS p{i}" for i in spans)
    dens = ", ".join(f"CAST(sum(d) FILTER (p = {i}) AS BIGINT) AS d{i}" for i in spans)
    return f"""
    WITH base AS (
        SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_returnflag AS indicator, {_CENTS} AS v, CAST(l_quantity AS BIGINT) AS d,
               least(13, (dayofyear(l_shipdate) - 1) // 28 + 1) AS p FROM lineitem),
    wide AS (SELECT year, indicator, {values}, CAST(sum(v) AS BIGINT) AS total, {dens}, CAST(sum(d) AS BIGINT) AS denominator
             FROM base GROUP BY ALL)
    SELECT w.*, e.total AS previous_total FROM wide w LEFT JOIN wide e ON e.year = w.year - 1 AND e.indicator = w.indicator
"""


@query("g4_period_pivot", _pivot_sql())
def g4_period_pivot(spark, sf):
    lines = table(spark, sf, "lineitem")
    return period_pivot(lines, "l_returnflag", "l_shipdate", cents(F.col("l_extendedprice")), F.col("l_quantity").cast("bigint"))


@query("g5_duration_days", """
    SELECT l_orderkey, strftime(min(l_shipdate), '%Y-%m-%d') AS "start", strftime(max(l_shipdate), '%Y-%m-%d') AS "end",
           CAST(datediff('day', min(l_shipdate), max(l_shipdate)) AS INTEGER) AS days
    FROM lineitem GROUP BY l_orderkey
""")
def g5_duration_days(spark, sf):
    spans = duration_days(table(spark, sf, "lineitem"), "l_orderkey", "l_shipdate")
    return spans.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("start", "end")})


@query("g6_weekly_summary", """
    SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_patients
    FROM events GROUP BY ALL
""")
def g6_weekly_summary(spark, sf):
    weeks = weekly_summary(table(spark, sf, "events"), "ts", "event_type", "user_id")
    return weeks.withColumn("week", F.date_format("week", "yyyy-MM-dd"))


@query("g7_duplicates", """
    SELECT g.group_id, d.doc_id, g.n FROM documents d
    JOIN (SELECT trim(lower(text)) AS t, min(doc_id) AS group_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1) g
      ON g.t = trim(lower(d.text))
""")
def g7_duplicates(spark, sf):
    return duplicates(table(spark, sf, "documents"), "doc_id", F.trim(F.lower("text")))


_FIELDS = ["status", "custkey", "price_cents"]


@query("g8_forms_wide", """
    SELECT form, doc, max_by(value, ts) FILTER (field = 'status') AS status, max_by(value, ts) FILTER (field = 'custkey') AS custkey,
           max_by(value, ts) FILTER (field = 'price_cents') AS price_cents
    FROM captures GROUP BY form, doc
""", ("captures",))
def g8_forms_wide(spark, sf):
    return forms_wide(fx.form_captures(spark, sf), ["form", "doc"], "field", "value", ["ts"], _FIELDS)


@query("so1_union_systems", """
    SELECT doc, form, field, value, strftime(ts, '%Y-%m-%d') AS ts, CASE doc % 2 WHEN 0 THEN 'legacy' ELSE 'new' END AS origin,
           CASE WHEN doc % 2 = 1 THEN 'v2' END AS template FROM captures
""", ("captures",))
def so1_union_systems(spark, sf):
    captures = fx.form_captures(spark, sf)
    legacy = captures.where(F.col("doc") % 2 == 0)
    new = captures.where(F.col("doc") % 2 == 1).withColumn("template", F.lit("v2"))
    return union_systems(legacy, new).withColumn("ts", F.date_format("ts", "yyyy-MM-dd"))


@query("j13_new_forms", "SELECT DISTINCT form FROM captures WHERE form = '1-URGENT'", ("captures",))
def j13_new_forms(spark, sf):
    captures = fx.form_captures(spark, sf)
    configured = captures.where("form <> '1-URGENT'").select("form").distinct()
    return new_forms(captures, configured, "form")


@query("g9_lab_reference", """
    SELECT 'test' AS kind, event_type AS test_a, NULL AS test_b, count(*) AS n, CAST(min(round(value * 100)) AS BIGINT) AS min_value,
           CAST(max(round(value * 100)) AS BIGINT) AS max_value, count(DISTINCT user_id) AS n_patients FROM events GROUP BY event_type
    UNION ALL
    SELECT 'pair', a.t, b.t, count(*), NULL, NULL, NULL
    FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d, event_type AS t FROM events) a
    JOIN (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d, event_type AS t FROM events) b USING (user_id, d) WHERE a.t < b.t GROUP BY ALL
""")
def g9_lab_reference(spark, sf):
    events = table(spark, sf, "events")
    value = F.round(F.col("value") * 100).cast("bigint")
    stats = lab_statistics(events, "event_type", value, "user_id").withColumnRenamed("event_type", "test_a")
    pairs = lab_pairs(events, "event_type", "user_id", F.to_date("ts")).withColumnRenamed("n_patient_days", "n")
    return stats.withColumn("kind", F.lit("test")).unionByName(pairs.withColumn("kind", F.lit("pair")), allowMissingColumns=True)
