"""Indicator tables and reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.functions.grid import check_interval, ntz, slot_index, slot_start
from lakeops.operators.skew import lookup_join
from lakeops.session import durable

# A reporting year has thirteen periods of four weeks, the last one open-ended.
PERIODS = 13
PERIOD_DAYS = 28


def cents(c: Column) -> Column:
    """Money as whole cents, so that sums do not depend on the order of addition."""
    return F.round(c * 100).cast("bigint")


def period_of_year(c: Column) -> Column:
    return F.least(F.lit(PERIODS), F.floor((F.dayofyear(c) - 1) / PERIOD_DAYS).cast("int") + 1)


def period_pivot(df: DataFrame, indicator: str, ts: str, value: Column, denominator: Column) -> DataFrame:
    """Per (year, indicator): thirteen period sums and denominators, totals, last year's total.

    Sums are conditional aggregates over one shuffle of (year, indicator); the year-on-year step runs
    on the small result.
    """
    period = period_of_year(F.col(ts))
    base = df.select(
        F.year(ts).alias("year"), F.col(indicator).alias("indicator"), period.alias("p"), value.alias("v"), denominator.alias("d")
    )

    def of(name: str, i: int) -> Column:
        return F.sum(F.when(F.col("p") == i, F.col(name))).alias(f"{'p' if name == 'v' else 'd'}{i}")

    spans = range(1, PERIODS + 1)
    wide = base.groupBy("year", "indicator").agg(
        *[of("v", i) for i in spans], F.sum("v").alias("total"), *[of("d", i) for i in spans], F.sum("d").alias("denominator")
    )
    earlier = wide.select((F.col("year") + 1).alias("year"), "indicator", F.col("total").alias("previous_total"))
    return wide.join(earlier, ["year", "indicator"], "left")


def duration_days(df: DataFrame, key: str, ts: str) -> DataFrame:
    """First and last day of each encounter and the whole days between them."""
    spans = df.groupBy(key).agg(F.min(ts).alias("start"), F.max(ts).alias("end"))
    return spans.withColumn("days", F.datediff("end", "start"))


def weekly_summary(df: DataFrame, ts: str, category: str, patient: str) -> DataFrame:
    """Events and distinct patients per ISO week and category."""
    week = F.date_trunc("week", ts).cast("timestamp_ntz")
    return df.groupBy(week.alias("week"), category).agg(
        F.count(F.lit(1)).alias("n_events"), F.count_distinct(patient).alias("n_patients")
    )


def duplicates(df: DataFrame, key: str, identity: Column) -> DataFrame:
    """Members of every group that shares an identity, with the group's size and lowest key.

    Groups come out one row per member: a group may hold any share of the table, so it is never
    collected. Texts are digested once, sizes counted on the digest and then looked up by it.
    """
    digest = F.sha2(identity, 256)
    members = durable(df.select(key, digest.alias("digest")))
    groups = members.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")).where("n > 1")
    return lookup_join(members, groups, ["digest"]).select(F.col("first").alias("group_id"), key, "n")


def lab_statistics(df: DataFrame, test: str, value: Column, patient: str) -> DataFrame:
    """Per test: results, lowest and highest value, distinct patients."""
    return df.groupBy(test).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("min_value"), F.max(value).alias("max_value"),
        F.count_distinct(patient).alias("n_patients"),
    )


def lab_pairs(df: DataFrame, test: str, patient: str, day: Column) -> DataFrame:
    """Pairs of tests seen for the same patient and day, with the number of patient-days.

    A patient-day becomes the sorted set of its tests, and equal sets are counted before any pair is
    formed: pairs are made once per distinct combination, weighted by how often it occurs.
    """
    combos = (
        df.groupBy(F.col(patient).alias("_p"), day.alias("_d")).agg(F.array_sort(F.collect_set(test)).alias("tests"))
        .groupBy("tests").agg(F.count(F.lit(1)).alias("n"))
    )
    firsts = combos.select("tests", "n", F.posexplode("tests").alias("i", "test_a"))
    return (
        firsts.select("test_a", "n", F.explode(F.slice("tests", F.col("i") + 2, F.size("tests"))).alias("test_b"))
        .groupBy("test_a", "test_b").agg(F.sum("n").alias("n_patient_days"))
    )


def next_start(last_end: Column, anchor: Column, interval: dt.timedelta) -> Column:
    """Where the next interval starts after one that ended at ``last_end`` on an older grid."""
    return slot_start(slot_index(last_end, anchor, interval), anchor, interval)


def interval_grid(spark, anchor: str, bound: str, interval: dt.timedelta, catchup: bool = True) -> DataFrame:
    """Contiguous half-open intervals ``k, start, end`` from the anchor that end by ``bound``.

    Without catch-up only the last completed interval, or the first one while none is complete.
    """
    check_interval(interval)
    begin, limit = dt.datetime.fromisoformat(anchor), dt.datetime.fromisoformat(bound)
    complete = max((limit - begin) // interval, 0)
    first, stop = (0, complete) if catchup else (max(complete - 1, 0), max(complete, 1))
    ks = spark.range(first, stop).select(F.col("id").alias("k"))
    origin = ntz(anchor)
    return ks.select(
        "k", slot_start(F.col("k"), origin, interval).alias("start"),
        slot_start(F.col("k") + 1, origin, interval).alias("end"),
    )


def backfill_extract(
    facts: DataFrame, ts: str, patient: str, cohort: DataFrame, anchor: str, bound: str, interval: dt.timedelta,
    catchup: bool = True,
) -> DataFrame:
    """Facts, cohort facts and cohort patients of every interval, empty intervals included.

    A fact finds its interval by arithmetic, not by a range join.
    """
    grid = interval_grid(facts.sparkSession, anchor, bound, interval, catchup)
    origin = ntz(anchor)
    inside = facts.where((F.col(ts) >= origin) & (F.col(ts) < ntz(bound)))
    known = cohort.select(patient).distinct().withColumn("_member", F.lit(True))
    counted = (
        inside.select(F.col(patient), slot_index(F.col(ts), origin, interval).alias("k"))
        .groupBy("k", patient).agg(F.count(F.lit(1)).alias("n"))
        .join(known, patient, "left")
        .groupBy("k").agg(
            F.sum("n").alias("n_facts"), F.sum(F.when(F.col("_member"), F.col("n"))).alias("n_cohort_facts"),
            F.count_if("_member").alias("n_cohort_patients"),
        )
    )
    names = ["n_facts", "n_cohort_facts", "n_cohort_patients"]
    return grid.join(counted, "k", "left").fillna(0, names)
