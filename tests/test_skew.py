import pytest
from pyspark.sql import functions as F

from lakeops.operators.skew import lookup_join


def skewed(spark):
    key = F.when(F.col("id") % 4 == 0, F.lit(None)).when(F.col("id") % 4 < 3, F.lit(7)).otherwise(F.col("id") % 50)
    return spark.range(4000).select("id", key.cast("int").alias("k"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("salts", [1, 5])
def test_result_is_that_of_a_plain_join(spark, how, salts):
    df, dim = skewed(spark), spark.range(0, 60, 3).select(F.col("id").cast("int").alias("k"), F.col("id").alias("v"))
    want = df.join(dim, ["k"], how)
    got = lookup_join(df, dim, ["k"], how, salts)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def plain(spark, **more):
    """Settings under which every join is shuffled and stays as planned."""
    return {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8", **more}


@pytest.mark.parametrize("how", ["left", "left_anti"])
def test_rows_without_a_key_are_spread(spark, how):
    settings = plain(spark)
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(8000).select("id", F.when(F.col("id") % 2 > 5, 1).alias("k"))
        dim = spark.range(10).select(F.col("id").cast("int").alias("k"))
        sizes = lookup_join(df, dim, ["k"], how).groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(sizes) == 8 and max(r["count"] for r in sizes) < 2 * 8000 / 8
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_planning_runs_no_job(spark):
    df, dim = skewed(spark), spark.range(10).select(F.col("id").cast("int").alias("k"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "no job may start here")
    try:
        lookup_join(df, dim, ["k"], "left")
        assert list(tracker.getJobIdsForGroup("planning")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


# Half of all rows have one key; every join is shuffled, and small partitions count as skewed.
HOT = {
    "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture
def hot(spark):
    before = {k: spark.conf.get(k, None) for k in HOT}
    for k, v in HOT.items():
        spark.conf.set(k, v)
    rows = spark.range(0, 120_000, 1, 8).select(
        "id", F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id") % 997).alias("patient"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=(F.col("id") % 9000).cast("int"))).alias("at"), F.repeat(F.lit("x"), 40).alias("note"))
    yield rows
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def is_split(df):
    """Whether a skewed partition was split; the result is run first, since only a final plan tells."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "skew=true" in plan.split("== Initial Plan ==")[0]


def test_hot_keys_of_lookups_are_split(spark, hot):
    from lakeops.operators import cohort, measures, studies

    few = spark.range(0, 600).select(F.col("id").alias("patient"))
    assert is_split(cohort.restrict_to_cohort(hot, few, "patient"))
    assert is_split(cohort.interval_extract(hot, few, "patient", "at", F.lit("2024-01-01").cast("timestamp"), F.lit("2025-01-01").cast("timestamp")))
    index = cohort.build_index(hot, "patient", "salt")
    assert is_split(cohort.anonymize(hot, index, "patient", ["note"], excluded=few.where("patient > 500")))
    assert is_split(measures.duplicates(hot, "id", F.col("patient").cast("string")))
    objects = hot.select(F.format_string("root/%s/part/%s.dcm", "patient", "id").alias("key"))
    wanted = few.select(F.format_string("root/%s", "patient").alias("study"))
    assert is_split(studies.objects_of_studies(objects, wanted))


def test_a_hot_key_is_split_below_an_aggregate_on_it(spark, hot):
    """The aggregate would otherwise rely on the partitioning of the join."""
    few = spark.range(0, 600).select(F.col("id").alias("patient"))
    counted = lookup_join(hot, few.distinct(), ["patient"], "left_semi").groupBy("patient").count()
    assert is_split(counted)
    assert counted.where("patient = 7").first()["count"] == hot.where("patient = 7").count()


@pytest.mark.parametrize("how", ["inner", "left_anti"])
def test_keys_of_different_types_meet(spark, how):
    df = spark.createDataFrame([(1, -0.0), (2, 3.0), (3, None)], "k int, d double")
    dim = spark.createDataFrame([(1, 0.0), (2, 4.0)], "k bigint, d double")
    for keys in (["k"], ["d"], ["k", "d"]):
        want = df.join(dim.select(*keys), keys, how)
        assert sorted(map(str, lookup_join(df, dim.select(*keys), keys, how).select(*want.columns).collect())) == sorted(map(str, want.collect())), keys
