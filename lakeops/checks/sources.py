"""Reader queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeops.checks.base import query, staged, table
from lakeops.operators.conform import conform
from lakeops.operators.manifests import index_documents, update_index
from lakeops.session import scratch_dir
from lakeops.sinks.tree import write_files
from lakeops.sources.files import read_manifests, read_messages
from lakeops.sources.registry import Dataset, Registry, Storage, read_dataset, read_matching, union_by_name
from lakeops.sources.tables import daily_slice, read_csv_dir, read_parquet_dir

DATASETS = {
    "anonymized_parts_names": ["p_partkey", "p_name"],
    "anonymized_parts_brands": ["p_partkey", "p_brand"],
    "anonymized_stock_full": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
}
_PARTS = """
    SELECT 'anonymized_parts_names' AS _dataset, p_partkey, p_name, NULL AS p_brand, NULL AS p_type, NULL AS p_size, NULL AS p_retailprice
    FROM part WHERE p_partkey % 3 = 0
    UNION ALL SELECT 'anonymized_parts_brands', p_partkey, NULL, p_brand, NULL, NULL, NULL FROM part WHERE p_partkey % 3 = 1
    UNION ALL SELECT 'anonymized_stock_full', p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part WHERE p_partkey % 3 = 2
"""


def split_parts(spark, sf, fmt):
    """Every part goes to one of three datasets with different columns."""
    def write(root):
        parts = table(spark, sf, "part")
        for i, (name, columns) in enumerate(DATASETS.items()):
            kept = parts.where(F.col("p_partkey") % 3 == i).select(*columns)
            kept.write.option("header", True).format(fmt).save(f"{root}/parts/{name}")

    return staged(spark, sf, f"parts-{fmt}", write)


def _registry(root):
    return Registry([Storage("anonymized", f"{root}/")], [Dataset(n, "anonymized", f"/parts/{n}") for n in DATASETS])


@query("s2_pattern_union", f"SELECT _dataset, p_partkey, p_name, p_brand FROM ({_PARTS}) WHERE _dataset LIKE 'anonymized_parts_%'")
def s2_pattern_union(spark, sf):
    registry = _registry(split_parts(spark, sf, "parquet"))
    return read_matching(spark, registry, ["anonymized_parts_*", "anonymized_*s_b*", "anonymized_zzz*"])


@query("s5_parquet_dir_union", f"SELECT * EXCLUDE (_dataset) FROM ({_PARTS})")
def s5_parquet_dir_union(spark, sf):
    return read_parquet_dir(spark, f"{split_parts(spark, sf, 'parquet')}/parts")


@query("s6_csv_dir_union", f"""
    SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size,
           CAST(round(p_retailprice * 100) AS BIGINT) AS price_cents FROM ({_PARTS})
""")
def s6_csv_dir_union(spark, sf):
    df = read_csv_dir(spark, f"{split_parts(spark, sf, 'csv')}/parts")
    cents = F.round(F.col("p_retailprice").cast("double") * 100).cast("bigint").alias("price_cents")
    return df.select("p_partkey", "p_name", "p_brand", "p_type", "p_size", cents)


@query("p15_conform_schema", f"""
    SELECT CAST(p_partkey AS INTEGER) AS p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size, CAST(NULL AS VARCHAR) AS p_comment
    FROM ({_PARTS})
""")
def p15_conform_schema(spark, sf):
    """Each dataset is brought to one declared schema: other types, a column none of them has."""
    declared = T.StructType().add("p_partkey", "integer").add("p_name", "string").add("p_size", "long").add("p_comment", "string")
    registry = _registry(split_parts(spark, sf, "parquet"))
    return union_by_name([conform(read_dataset(spark, registry, d), declared) for d in registry.select(["anonymized_*"])])


@query("s9_daily_slice", """
    SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts
    FROM events WHERE ts >= TIMESTAMP '2024-01-14' AND ts < TIMESTAMP '2024-01-15'
""")
def s9_daily_slice(spark, sf):
    rows = daily_slice(table(spark, sf, "events"), "ts", "2024-01-15", lag_days=1)
    return rows.select("event_id", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


# Names and barcodes of the known document types; one type is left out on purpose.
_TYPES = [("1-URGENT", "Urgent", "B1"), ("2-HIGH", "High", "B2"), ("3-MEDIUM", "Medium", "B3"), ("4-NOT SPECIFIED", "Other", "B4")]
_TYPE_ROWS = ", ".join(str(t) for t in _TYPES)


@query("s10_manifest_index", f"""
    SELECT o_orderkey AS "documentId", o_orderpriority AS type_code, name AS type_name, barcode,
           strftime(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END, '%Y-%m-%d') AS scanned
    FROM orders LEFT JOIN (VALUES {_TYPE_ROWS}) t(code, name, barcode) ON t.code = o_orderpriority
""")
def s10_manifest_index(spark, sf):
    """Each day has a manifest of its documents; urgent ones are listed again the day after.

    The run of the first half has indexed everything once; reading all days then updates it.
    """
    def write(root):
        orders = table(spark, sf, "orders")
        day = F.col("o_orderdate")
        again = orders.where(F.col("o_orderpriority") == "1-URGENT").withColumn("o_orderdate", day + F.expr("INTERVAL 1 DAY"))
        listed = orders.unionByName(again).select(
            F.date_format(day, "yyyy/MM/dd").alias("day"), F.floor(F.col("o_orderkey") / 1_000_000).alias("chunk"),
            F.concat_ws(",", "o_orderkey", "o_orderpriority", F.date_format(day, "yyyy-MM-dd")).alias("line"),
        )
        files = listed.groupBy("day", "chunk").agg(F.sort_array(F.collect_list("line")).alias("lines")).select(
            F.concat("day", F.lit("/scan_"), "chunk", F.lit(".idx")).alias("path"),
            F.concat(F.lit("documentId,type_code,scanned\n"), F.array_join("lines", "\n"), F.lit("\n")).alias("content"),
        )
        write_files(files, root).write.format("noop").mode("overwrite").save()

    root = staged(spark, sf, "manifests", write)
    found = read_manifests(spark, root, None, "documentId bigint, type_code string, scanned string")
    types = spark.createDataFrame(_TYPES, "type_code string, type_name string, barcode string")
    fresh = index_documents(found.drop("manifest"), types, "documentId", "type_code", ["scanned"])
    old = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("documentId"), F.lit("old").alias("type_code"), F.lit("old").alias("type_name"),
        F.lit("old").alias("barcode"), F.lit("1990-01-01").alias("scanned"),
    )
    return update_index(old, fresh, "documentId")


@query("s11_hl7_segments", """
    WITH n AS (SELECT unnest([1, 2, 3]) AS k)
    SELECT o_orderkey, 0 AS ordinal, 'MSH' AS segment, 'LAB' AS value, CAST(3 AS BIGINT) AS n_fields FROM orders
    UNION ALL SELECT o_orderkey, 1, 'PID', CAST(o_custkey AS VARCHAR), 3 FROM orders
    UNION ALL SELECT o_orderkey, 2, 'OBR', CAST(o_orderkey AS VARCHAR), 3 FROM orders
    UNION ALL SELECT o_orderkey, 2 + k, 'OBX', o_orderpriority, 5 FROM orders, n WHERE k <= o_orderkey % 3 + 1
""")
def s11_hl7_segments(spark, sf):
    obx = F.transform(
        F.sequence(F.lit(1), (F.col("o_orderkey") % 3 + 1).cast("int")),
        lambda n: F.concat_ws("|", F.lit("OBX"), n.cast("string"), F.lit("TX"), F.col("o_orderpriority"), n.cast("string")),
    )
    head = F.array(
        F.lit("MSH|^~\\&|LAB"), F.concat(F.lit("PID|1|"), "o_custkey"), F.concat(F.lit("OBR|1|"), "o_orderkey")
    )
    messages = table(spark, sf, "orders").select("o_orderkey", F.array_join(F.concat(head, obx), "\r").alias("body"))
    value = F.when(F.col("segment") == "OBX", F.get("fields", F.lit(3))).otherwise(F.get("fields", F.lit(2)))
    return read_messages(messages, "body", ["o_orderkey"]).select(
        "o_orderkey", "ordinal", "segment", value.alias("value"), F.size("fields").cast("bigint").alias("n_fields")
    )
