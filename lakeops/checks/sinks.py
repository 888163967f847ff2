"""Writer and maintenance queries; each writes to shared storage and returns what it reads back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeops.checks import fixtures as fx
from lakeops.checks.base import query, table
from lakeops.operators.maintenance import compact, orphans, retention
from lakeops.operators.measures import cents, duration_days, period_pivot
from lakeops.session import scratch_dir
from lakeops.sinks.refresh import refresh_tables, to_declared
from lakeops.sinks.release import publish_release, release_table, release_version
from lakeops.sinks.upsert import insert_ignore, upsert, upsert_files
from lakeops.sources.registry import Dataset, Registry, Storage, union_by_name
from lakeops.sources.tables import read_csv_dir


def _target(spark, sf):
    return table(spark, sf, "customer").where("c_nationkey >= 5").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"),
        F.lit("t").alias("note"), F.lit("2020-01-01").alias("created_at"),
    )


def _staging(spark, sf):
    return table(spark, sf, "customer").where("c_mktsegment IN ('BUILDING', 'MACHINERY')").select(
        F.col("c_custkey").alias("id"), F.upper("c_name").alias("name"), F.lower("c_mktsegment").alias("segment"),
        F.lit("2024-01-01").alias("created_at"),
    )


_OLD = "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, 't' AS note, '2020-01-01' AS created_at FROM customer WHERE c_nationkey >= 5"
_NEW = "SELECT c_custkey AS id, upper(c_name) AS name, lower(c_mktsegment) AS segment, '2024-01-01' AS created_at FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"


@query("k2_upsert", f"""
    SELECT coalesce(o.id, n.id) AS id, coalesce(n.name, o.name) AS name, coalesce(n.segment, o.segment) AS segment,
           o.note, coalesce(o.created_at, n.created_at) AS created_at
    FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.id = n.id
""")
def k2_upsert(spark, sf):
    return upsert(_target(spark, sf), _staging(spark, sf), ["id"], ["created_at"])


@query("k2c_upsert_files", f"""
    SELECT coalesce(o.id, n.id) AS id, coalesce(n.name, o.name) AS name, coalesce(n.segment, o.segment) AS segment,
           o.note, coalesce(o.created_at, n.created_at) AS created_at
    FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.id = n.id
""")
def k2c_upsert_files(spark, sf):
    """The target is a table of several files, changed in place and read back."""
    path = scratch_dir(spark, "upserted")
    _target(spark, sf).repartitionByRange(8, "id").write.parquet(path)
    upsert_files(spark, path, _staging(spark, sf), ["id"], ["created_at"])
    return spark.read.parquet(path)


@query("k2b_insert_ignore", f"""
    SELECT * FROM ({_OLD})
    UNION ALL SELECT id, name, segment, NULL, created_at FROM ({_NEW}) WHERE id NOT IN (SELECT id FROM ({_OLD}))
""")
def k2b_insert_ignore(spark, sf):
    """Every staging row comes twice; the first by its ordinal is the one that stays."""
    staging = _staging(spark, sf)
    later = staging.withColumn("name", F.lit("again"))
    both = staging.withColumn("ordinal", F.lit(0)).unionByName(later.withColumn("ordinal", F.lit(1)))
    return insert_ignore(_target(spark, sf), both, ["id"], ["ordinal"])


_STAYS = T.StructType().add("encounter", "long").add("start", "string").add("end", "string").add("days", "integer").add("note", "string")
_INFECTIONS = (
    T.StructType().add("year", "integer").add("indicator", "string").add("total", "long").add("denominator", "long")
    .add("previous_total", "long")
)


@query("k3_full_refresh", """
    SELECT 'stays' AS table_name, CAST(l_orderkey AS VARCHAR) AS key, CAST(datediff('day', min(l_shipdate), max(l_shipdate)) AS BIGINT) AS v,
           count(NULL) AS n_notes FROM lineitem GROUP BY l_orderkey
    UNION ALL
    SELECT 'infections', year(l_shipdate) || l_returnflag, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT), 0
    FROM lineitem GROUP BY year(l_shipdate), l_returnflag
""")
def k3_full_refresh(spark, sf):
    """Two tables are loaded from CSV sources whose headers name only some of their columns."""
    root, out = scratch_dir(spark, "sources"), scratch_dir(spark, "indicators")
    lines = table(spark, sf, "lineitem")
    spans = duration_days(lines, "l_orderkey", "l_shipdate")
    spans.select(F.col("l_orderkey").alias("encounter"), F.date_format("start", "yyyy-MM-dd").alias("start"), "days") \
        .write.option("header", True).csv(f"{root}/stays")
    period_pivot(lines, "l_returnflag", "l_shipdate", cents(F.col("l_extendedprice")), F.col("l_quantity").cast("bigint")) \
        .select("year", "indicator", "total").write.option("header", True).csv(f"{root}/infections")
    declared = {"stays": _STAYS, "infections": _INFECTIONS}
    refresh_tables(spark, out, {n: spark.createDataFrame([], s) for n, s in declared.items()})
    fresh = refresh_tables(spark, out, {n: to_declared(read_csv_dir(spark, f"{root}/{n}"), s) for n, s in declared.items()})
    stays, infections = (fresh.read(n, declared[n]) for n in declared)
    note = F.when(F.col("note").isNotNull(), 1).otherwise(0).cast("bigint").alias("n_notes")
    return stays.select(
        F.lit("stays").alias("table_name"), F.col("encounter").cast("string").alias("key"), F.col("days").cast("bigint").alias("v"), note
    ).unionByName(infections.select(
        F.lit("infections").alias("table_name"), F.concat("year", "indicator").alias("key"), F.col("total").alias("v"),
        F.lit(0).cast("bigint").alias("n_notes"),
    ))


def _shop(spark, sf, base):
    """Releases of a resource: an early dated one, a later one, and the rolling one."""
    mark = F.lit("\x01")
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.concat(mark, "c_name").alias("name"))
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.concat(mark, "s_name").alias("name"))
    early = table(spark, sf, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("key"), F.concat(mark, "c_name").alias("name"))
    dated = release_version("latest", "2024-02-02T03:00:00", pass_date=True)
    rolling = release_version("latest", "2024-02-02T03:00:00", pass_date=False)
    release_table(early, base, "shop", release_version("2024-01-05", "2024-02-02", pass_date=True), "customer")
    for version in (dated, rolling):
        release_table(customers, base, "shop", version, "customer")
        release_table(suppliers, base, "shop", version, "supplier")


@query("k5_release_version", """
    SELECT '2024-01-05' AS version, 'customer' AS table_name, c_custkey AS key, chr(1) || c_name AS name FROM customer WHERE c_nationkey < 10
    UNION ALL SELECT v, 'customer', c_custkey, chr(1) || c_name FROM customer, (VALUES ('2024-02-02'), ('latest')) t(v)
    UNION ALL SELECT v, 'supplier', s_suppkey, chr(1) || s_name FROM supplier, (VALUES ('2024-02-02'), ('latest')) t(v)
""")
def k5_release_version(spark, sf):
    base = scratch_dir(spark, "shop")
    _shop(spark, sf, base)
    rows = spark.read.option("recursiveFileLookup", True).schema("key bigint, name string").parquet(f"{base}/released/shop")
    path = F.split(F.col("_metadata.file_path"), "/released/shop/")[1]
    return rows.select(
        F.split(path, "/")[0].alias("version"), F.split(path, "/")[1].alias("table_name"), "key", "name"
    )


@query("k6_publish_tables", """
    SELECT 'open-shelf' AS bucket, 'published/shop/2024-02-02/customer_2024_02_02.csv' AS path, CAST(c_custkey AS VARCHAR) AS key, c_name AS name
    FROM customer
    UNION ALL
    SELECT 'published-clinical-shop', '/shop/2024-02-02/supplier_2024_02_02.csv', CAST(s_suppkey AS VARCHAR), s_name FROM supplier
""")
def k6_publish_tables(spark, sf):
    base, out = scratch_dir(spark, "shop"), scratch_dir(spark, "published")
    _shop(spark, sf, base)
    registry = Registry(
        [Storage("green", "s3a://open-shelf"), Storage("clinical", "s3a://published-clinical-shop")],
        [Dataset("published_shop_customer", "green", "/shop/{{version}}/customer_{{version}}"),
         Dataset("published_shop_supplier", "clinical", "/shop/{{version}}/supplier_{{version}}")],
    )
    plan = publish_release(spark, registry, base, "shop", "2024-02-02", out, "open-shelf", rows_per_file=100)
    exported = []
    for step in plan.collect():  # one row per table
        rows = spark.read.option("header", True).option("escape", '"').csv(f"{out}/{step.bucket}/{step.path.lstrip('/')}")
        exported.append(rows.select(F.lit(step.bucket).alias("bucket"), F.lit(step.path).alias("path"), "key", "name"))
    return union_by_name(exported)


@query("t1_compact", "SELECT * FROM lineitem")
def t1_compact(spark, sf):
    """The table is written as many small files and compacted; its content must not change."""
    path = scratch_dir(spark, "lineitem")
    table(spark, sf, "lineitem").repartition(64).write.parquet(path)
    compact(spark, path)
    return spark.read.parquet(path)


@query("t2_retention", """
    SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events
    WHERE CAST(ts AS DATE) >= DATE '2024-01-21' GROUP BY ALL
""")
def t2_retention(spark, sf):
    """Each day of an event type is a version; the ten newest stay."""
    events = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    kept = retention(events, "event_type", "day", keep=10)
    return kept.groupBy("event_type", F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("t4_orphans", "SELECT key AS path FROM objects WHERE CAST(regexp_extract(key, '([0-9]+)\\.dcm$', 1) AS BIGINT) % 13 = 0",
       ("study_orders", "objects"))
def t4_orphans(spark, sf):
    """The manifest leaves out every thirteenth part number."""
    listing = fx.stored_objects(spark, sf).select(F.col("key").alias("path"))
    number = F.regexp_extract("path", r"([0-9]+)\.dcm$", 1).cast("bigint")
    return orphans(listing, listing.where(number % 13 != 0))
