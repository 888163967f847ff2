"""Queries over time: latest rows, grids, intervals, change history."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lakeops.checks import fixtures as fx
from lakeops.checks.base import query, table
from lakeops.functions.grid import anchored_slot, ntz
from lakeops.operators.cohort import interval_extract
from lakeops.operators.measures import backfill_extract
from lakeops.operators.ordering import as_of, latest_per_key, status_history

WEEK = dt.timedelta(days=7)
MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"
_STAMP = "'%Y-%m-%d %H:%M:%S.%f'"


def _at(c):
    return F.date_format(c, MICROS)


@query("j11_interval_extract", f"""
    SELECT 'interval' AS kind, event_id, user_id, strftime(ts, {_STAMP}) AS ts FROM events
    WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-22' AND user_id IN (SELECT id FROM cohort)
    UNION ALL
    SELECT 'as of', event_id, user_id, strftime(ts, {_STAMP}) FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE ts < TIMESTAMP '2024-01-22')
    WHERE r = 1 AND user_id IN (SELECT id FROM cohort)
""", ("cohort",))
def j11_interval_extract(spark, sf):
    """The month's cohort events, and the state of each cohort patient at its end."""
    events, members = table(spark, sf, "events"), fx.cohort(spark, sf, "user_id")
    end = ntz("2024-01-22")
    inside = interval_extract(events, members, "user_id", "ts", ntz("2024-01-08"), end)
    state = as_of(events.join(members, "user_id", "left_semi"), ["user_id"], "ts", end, "event_id")
    return inside.withColumn("kind", F.lit("interval")).unionByName(state.withColumn("kind", F.lit("as of"))).select(
        "kind", "event_id", "user_id", _at("ts").alias("ts")
    )


@query("w2_latest_per_key", f"""
    SELECT user_id, event_type, event_id, strftime(ts, {_STAMP}) AS ts, CAST(round(value * 100) AS BIGINT) AS cents FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events)
    WHERE r = 1
""")
def w2_latest_per_key(spark, sf):
    newest = latest_per_key(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    return newest.select("user_id", "event_type", "event_id", _at("ts").alias("ts"), F.round(F.col("value") * 100).cast("bigint").alias("cents"))


_FLOOR = "greatest(time_bucket(INTERVAL 7 DAYS, ts, TIMESTAMP '2024-01-03 03:00:00'), TIMESTAMP '2024-01-03 03:00:00')"
_CEIL = f"""CASE WHEN ts <= TIMESTAMP '2024-01-03 03:00:00' THEN TIMESTAMP '2024-01-03 03:00:00' WHEN ts = {_FLOOR} THEN ts
            ELSE {_FLOOR} + INTERVAL 7 DAYS END"""


@query("w3_anchored_grid", f"""
    SELECT event_id, strftime({_FLOOR}, {_STAMP}) AS slot, strftime({_FLOOR} + INTERVAL 7 DAYS, {_STAMP}) AS slot_end,
           strftime({_CEIL}, {_STAMP}) AS next_slot
    FROM events
""")
def w3_anchored_grid(spark, sf):
    anchor, ts = ntz(fx.ANCHOR), F.col("ts")
    slot = anchored_slot(ts, anchor, WEEK)
    return table(spark, sf, "events").select(
        "event_id", _at(slot).alias("slot"), _at(slot + F.lit(WEEK)).alias("slot_end"),
        _at(anchored_slot(ts, anchor, WEEK, "ceil")).alias("next_slot"),
    )


@query("w4_backfill_extract", f"""
    SELECT CAST(k AS BIGINT) AS k, strftime(s, {_STAMP}) AS "start", strftime(s + INTERVAL 7 DAYS, {_STAMP}) AS "end",
           count(event_id) AS n_facts, count(event_id) FILTER (user_id IN (SELECT id FROM cohort)) AS n_cohort_facts,
           count(DISTINCT user_id) FILTER (user_id IN (SELECT id FROM cohort)) AS n_cohort_patients
    FROM (SELECT k, TIMESTAMP '2024-01-03 03:00:00' + to_days(CAST(7 * k AS INTEGER)) AS s FROM range(0, 8) t(k)) g
    LEFT JOIN events ON ts >= s AND ts < s + INTERVAL 7 DAYS AND ts < TIMESTAMP '2024-02-28 10:00:00'
    GROUP BY ALL
""", ("cohort",))
def w4_backfill_extract(spark, sf):
    grid = backfill_extract(
        table(spark, sf, "events"), "ts", "user_id", fx.cohort(spark, sf, "user_id"), fx.ANCHOR, "2024-02-28 10:00:00", WEEK
    )
    return grid.withColumns({"start": _at("start"), "end": _at("end")})


@query("w5_status_history", f"""
    SELECT user_id, event_type, strftime(ts, {_STAMP}) AS valid_from,
           strftime(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), {_STAMP}) AS valid_to
    FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    WHERE before IS NULL OR before <> event_type
""")
def w5_status_history(spark, sf):
    spans = status_history(table(spark, sf, "events"), ["user_id"], "ts", "event_id", "event_type", F.to_date("ts"))
    return spans.withColumns({"valid_from": _at("valid_from"), "valid_to": _at("valid_to")})
