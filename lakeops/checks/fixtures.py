"""Inputs the operators expect, derived by Spark from the given tables.

Nothing is random and nothing depends on the clock. The same derivations are written as SQL in
``CTES`` below each function.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from lakeops.checks.base import CTES, staged, table
from lakeops.operators.catalog import Catalog
from lakeops.session import small_batches

# ---------------------------------------------------------------- documents

FIRST_DAY, LAST_DAY = "2024-01-01", "2024-01-31"
WINDOW = ("2024-01-05", "2024-01-20")


def obx(spark: SparkSession, sf: str) -> DataFrame:
    """Base64 documents by day: PDFs, RTFs, undecodable and unknown payloads."""
    k = F.col("doc_id") % 8
    text = F.col("text")
    body = F.when(k.isin(0, 1, 4, 5), F.concat(F.lit("%PDF-1.7\n"), text)).when(
        k.isin(2, 6), F.concat(F.lit("{\\rtf1 "), text)
    ).otherwise(text)
    payload = F.when(k == 3, "JVBERi0").otherwise(F.base64(F.encode(body, "UTF-8")))
    return table(spark, sf, "documents").select(
        F.concat(F.lit("DOC-"), "doc_id", F.when(F.col("doc_id") % 5 == 0, "/1").otherwise("_1")).alias("hl7_id"),
        payload.alias("observation_value_base64"),
        F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("doc_id") % 30).cast("int")), "yyyy-MM-dd")
        .alias("dte_of_message"),
    )


def obx_table(spark: SparkSession, sf: str) -> str:
    """The documents as a day-partitioned table in storage."""
    return staged(
        spark, sf, "obx",
        lambda path: obx(spark, sf).repartition("dte_of_message", F.pmod(F.xxhash64("hl7_id"), F.lit(4)))
        .write.partitionBy("dte_of_message").parquet(path),
    )


def line_parser():
    """Stand-in parser: each non-empty line is a table of one row; short texts fail."""
    magic = "%PDF-1.7\n"

    def parse(hl7_id: str, raw: bytes) -> dict:
        text = raw.decode("utf-8").removeprefix(magic)
        if len(text) < 100:
            return {"status": "failure"}
        lines = [line for line in text.split("\n") if line]
        tables = [(line, 1, len([w for w in line.split(" ") if w]), None) for line in lines]
        return {"status": "success", "markdown": f"# {hl7_id}\n\n{text}", "tables": tables}

    return parse


CTES["obx"] = r"""
    SELECT doc_id, text, doc_id % 8 AS k,
           'DOC-' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '/1' ELSE '_1' END AS hl7_id,
           strftime(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER), '%Y-%m-%d') AS dte_of_message,
           CASE WHEN doc_id % 8 IN (0, 1, 4, 5) THEN '%PDF-1.7' || chr(10) || text
                WHEN doc_id % 8 IN (2, 6) THEN '{\rtf1 ' || text
                WHEN doc_id % 8 = 7 THEN text END AS body
    FROM documents
"""
CTES["decoded"] = r"""
    SELECT *,
           CASE WHEN body IS NULL THEN 'other' WHEN left(body, 5) = '%PDF-' THEN 'pdf'
                WHEN left(body, 5) = '{\rtf' THEN 'rtf' ELSE 'other' END AS source_format
    FROM obx
"""
CTES["outcomes"] = r"""
    SELECT hl7_id, dte_of_message, text, k, source_format,
           CASE WHEN source_format <> 'pdf' THEN 'skipped' WHEN length(text) < 100 THEN 'failure'
                ELSE 'success' END AS parse_status,
           CASE WHEN body IS NULL THEN 'base64 decode: invalid payload'
                WHEN source_format <> 'pdf' THEN 'unsupported format: ' || source_format
                WHEN length(text) < 100 THEN 'docling conversion failed' END AS parse_error,
           CASE WHEN source_format = 'pdf' AND length(text) >= 100
                THEN '# ' || hl7_id || chr(10) || chr(10) || text END AS report_markdown
    FROM decoded
"""
CTES["doc_tables"] = r"""
    SELECT hl7_id, dte_of_message, CAST(i - 1 AS BIGINT) AS table_index, lines[i] AS table_csv
    FROM (SELECT hl7_id, dte_of_message,
                 list_filter(string_split(text, chr(10)), lambda x: x <> '') AS lines
          FROM outcomes WHERE report_markdown IS NOT NULL) d,
         unnest(generate_series(1, len(lines))) AS u(i)
"""

# ---------------------------------------------------------------- studies

PARENT = "dicoms"
WORK_DIR = "/scratch/job-17"
PATTERNS = ["dicoms/1995/03", "dicoms/1996/*/*/RA0000*", "dicoms/1998/01/01/RA99999999", "dicoms/1997/01/*/ZZ*"]


def _study(key: str, day: str):
    return F.concat(
        F.lit("dicoms/"), F.date_format(day, "yyyy/MM/dd"), F.lit("/RA"), F.lpad(F.col(key).cast("string"), 8, "0")
    )


def study_orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_orderdate", _study("o_orderkey", "o_orderdate").alias("study"))


def study_objects(spark: SparkSession, sf: str) -> DataFrame:
    """``(o_orderkey, study, key)``: the objects stored below each study."""
    series = F.when(F.col("l_returnflag") == "A", "Ward 4 Basic Text SR").when(
        F.col("l_returnflag") == "N", "KNEE COR PD"
    ).otherwise("Viewer presentation state 3")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_returnflag").distinct()
    return lines.join(study_orders(spark, sf), "o_orderkey").select(
        "o_orderkey", "study", F.concat("study", F.lit("/"), series, F.lit("/"), "l_partkey", F.lit(".dcm")).alias("key")
    )


def stored_objects(spark: SparkSession, sf: str) -> DataFrame:
    """The objects as a listing in storage, read by several operators."""
    path = staged(spark, sf, "objects", lambda p: study_objects(spark, sf).write.parquet(p))
    return spark.read.parquet(path)


def study_log():
    return F.concat(
        F.lit(f"412 slices read\nno pixels in {WORK_DIR}/"), F.col("study"),
        F.lit("/KNEE COR PD/slice-0007.2.25.88.dcm\ngeometry of 2.25.7001.4.19.333.8 differs\n400 slices kept, 12 left out\n"),
    )


def study_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Everything known of a study before its status is decided."""
    from lakeops.operators.studies import report_only

    per_study = report_only(study_objects(spark, sf), "o_orderkey", "key")
    k = F.col("o_orderkey")
    return (
        study_orders(spark, sf).join(per_study, "o_orderkey", "left")
        .withColumn("n_objects", F.coalesce("n_objects", F.lit(0)))
        .select(
            "o_orderkey", "study", "n_objects", F.coalesce("report_only", F.lit(False)).alias("report_only"),
            (k % 10 == 9).alias("output_exists"),
            F.when(k % 8 == 0, 2).when(k % 8 == 1, 8).when(k % 8 == 2, 1).otherwise(0).alias("rc"),
            F.when(k % 50 == 0, 0).otherwise(F.col("n_objects")).cast("bigint").alias("output_files"),
            study_log().alias("raw_log"),
        )
    )


def patterns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(PATTERNS)), "ordinal int, pattern string")


def cohort_file(spark: SparkSession, sf: str) -> str:
    """A cohort list with every order: ISO dates, padded dates, other notations, gaps."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    loose = F.concat(F.lit(" "), F.year(day), F.lit("-"), F.month(day), F.lit("-"), F.dayofmonth(day), F.lit(" "))
    text = (
        F.when(k % 7 == 0, F.date_format(day, "dd/MM/yyyy")).when(k % 11 == 0, F.lit(None).cast("string"))
        .when(k % 5 == 0, loose).otherwise(F.date_format(day, "yyyy-MM-dd"))
    )
    rows = table(spark, sf, "orders").select(
        F.concat(F.lit("RA"), F.lpad(k.cast("string"), 8, "0")).alias("accessionNumber"), text.alias("examDate")
    )
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    return staged(spark, sf, "cohort", lambda path: rows.write.options(**keep).option("header", True).csv(path))


CTES["study_orders"] = """
    SELECT o_orderkey, o_orderdate,
           'dicoms/' || strftime(o_orderdate, '%Y/%m/%d') || '/RA' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS study
    FROM orders
"""
CTES["objects"] = """
    SELECT s.o_orderkey, s.study,
           s.study || '/' || CASE l_returnflag WHEN 'A' THEN 'Ward 4 Basic Text SR' WHEN 'N' THEN 'KNEE COR PD'
                                  ELSE 'Viewer presentation state 3' END || '/' || l_partkey || '.dcm' AS key
    FROM (SELECT DISTINCT l_orderkey, l_partkey, l_returnflag FROM lineitem) l
    JOIN study_orders s ON s.o_orderkey = l.l_orderkey
"""
CTES["object_facts"] = """
    SELECT o_orderkey, count(*) AS n_objects,
           bool_and(contains(lower(key), 'sr for hl7') OR contains(lower(key), 'basic text sr')
                 OR contains(lower(key), 'structured report') OR contains(lower(key), 'radiological report')
                 OR contains(lower(key), 'rapport') OR contains(lower(key), 'dose report')
                 OR contains(lower(key), 'presentation state')) AS report_only
    FROM objects GROUP BY o_orderkey
"""
CTES["logs"] = r"""
    SELECT o_orderkey, study,
           '412 slices read' || chr(10) || 'no pixels in /scratch/job-17/' || study || '/KNEE COR PD/slice-0007.2.25.88.dcm' || chr(10)
           || 'geometry of 2.25.7001.4.19.333.8 differs' || chr(10) || '400 slices kept, 12 left out' || chr(10) AS raw_log
    FROM study_orders
"""
CTES["scrubbed"] = r"""
    SELECT o_orderkey, study,
           regexp_replace(regexp_replace(replace(raw_log, '/scratch/job-17/', ''),
                          '[^/\s]+\.dcm(?:\.cmp)?\b', '<file>', 'g'),
                          '\b\d+(?:\.\d+){4,}\b', '<uid>', 'g') AS log
    FROM logs
"""
CTES["facts"] = """
    SELECT s.o_orderkey, s.study, s.log, coalesce(f.n_objects, 0) AS n_objects,
           coalesce(f.report_only, false) AS report_only, s.o_orderkey % 10 = 9 AS output_exists,
           CASE s.o_orderkey % 8 WHEN 0 THEN 2 WHEN 1 THEN 8 WHEN 2 THEN 1 ELSE 0 END AS rc,
           CASE WHEN s.o_orderkey % 50 = 0 THEN 0 ELSE coalesce(f.n_objects, 0) END AS output_files
    FROM scrubbed s LEFT JOIN object_facts f USING (o_orderkey)
"""
CTES["statuses"] = """
    SELECT *, CASE WHEN output_exists THEN 'skipped' WHEN n_objects = 0 THEN 'missing'
                   WHEN rc = 2 AND report_only THEN 'report only' WHEN rc NOT IN (0, 8) THEN 'failed'
                   WHEN output_files = 0 THEN 'failed' WHEN rc = 8 THEN 'partial' ELSE 'ok' END AS status
    FROM facts
"""
CTES["study_outcomes"] = """
    SELECT study, status, CASE WHEN status IN ('ok', 'partial', 'report only') THEN rc END AS exit_code,
           CASE WHEN status IN ('ok', 'partial') THEN output_files ELSE 0 END AS files_converted,
           status IN ('ok', 'partial') AS uploaded,
           CASE WHEN status IN ('partial', 'report only') THEN log
                WHEN status = 'failed' AND rc = 2 THEN 'no images converted although some series are images (exit code 2): ' || log
                WHEN status = 'failed' AND rc NOT IN (0, 8) THEN 'converter gave up (exit code ' || rc || '): ' || log
                WHEN status = 'failed' THEN 'converter wrote no file (exit code ' || rc || '): ' || log
                ELSE '' END AS output
    FROM statuses
"""
CTES["patterns"] = """
    SELECT * FROM (VALUES (0, 'dicoms/1995/03'), (1, 'dicoms/1996/*/*/RA0000*'),
                          (2, 'dicoms/1998/01/01/RA99999999'), (3, 'dicoms/1997/01/*/ZZ*')) p(ordinal, pattern)
"""
CTES["resolved"] = """
    SELECT ordinal, pattern, study FROM patterns
    JOIN (SELECT DISTINCT study FROM objects) o
      ON (pattern NOT LIKE '%*%' AND starts_with(study, pattern || '/')) OR (pattern LIKE '%*%' AND study GLOB pattern)
    WHERE ordinal <> 2
    UNION ALL SELECT ordinal, pattern, pattern FROM patterns WHERE ordinal = 2
"""
CTES["study_missing"] = """
    SELECT 'unmatched' AS reason, pattern AS item, CAST(ordinal AS BIGINT) AS rank
    FROM patterns WHERE ordinal NOT IN (SELECT ordinal FROM resolved)
    UNION ALL
    SELECT 'empty', study, 4611686018427387904 FROM (SELECT DISTINCT study FROM resolved) r
    WHERE study NOT IN (SELECT study FROM objects)
"""

CTES["asked"] = """
    SELECT o_orderkey AS ordinal, s.study || '*' AS pattern, f.o_orderkey IS NULL AS nothing
    FROM study_orders s LEFT JOIN object_facts f USING (o_orderkey)
"""

# ---------------------------------------------------------------- image objects


@F.pandas_udf(BinaryType())
def _pack(content: pd.Series) -> pd.Series:
    return content.map(lambda c: bytes(8) + zlib.compress(bytes(c)))


def image_objects(spark: SparkSession, sf: str) -> DataFrame:
    """``(path, content)``: one object per page, most of them compressed, some without the marker."""
    small_batches(spark)
    pid = F.col("page_id")
    html = F.encode("html", "UTF-8")
    inner = F.when(pid % 10 == 3, html).otherwise(F.concat(F.lit(bytes(128) + b"DICM"), html))
    name = F.concat(F.lit("dicoms/RA"), F.lpad(pid.cast("string"), 8, "0"), F.lit("/img.dcm"))
    return (
        table(spark, sf, "pages").select(pid, name.alias("name"), inner.alias("inner"))
        .withColumn("packed", _pack("inner"))
        .select(
            F.when(pid % 5 == 0, F.col("name")).otherwise(F.concat("name", F.lit(".cmp"))).alias("path"),
            F.when(pid % 5 == 0, F.col("inner")).otherwise(F.col("packed")).alias("content"),
        )
    )


CTES["image_objects"] = """
    SELECT 'dicoms/RA' || lpad(CAST(page_id AS VARCHAR), 8, '0') || '/img.dcm' AS key,
           CASE WHEN page_id % 10 <> 3 THEN 132 + octet_length(encode(html)) END AS n_bytes,
           CASE WHEN page_id % 10 = 3 THEN 'no DICM marker after inflating' END AS error
    FROM pages
"""

# ---------------------------------------------------------------- catalog


def catalog(spark: SparkSession, sf: str) -> Catalog:
    region, nation, supplier, part, lineitem = (table(spark, sf, n) for n in ("region", "nation", "supplier", "part", "lineitem"))
    rk, nk, sk = F.col("r_regionkey"), F.col("n_nationkey"), F.col("s_suppkey")
    brand = (F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int") % 25).alias("value_set_id")
    resource = region.select(
        rk.alias("id"), F.lower("r_name").alias("code"), F.col("r_name").alias("name"),
        F.when(rk < 2, "source_system").otherwise("research_project").alias("resource_type"),
        F.concat(F.lit("about "), "r_name").alias("description_en"), F.concat(F.lit("de "), "r_name").alias("description_fr"),
        (rk % 2 == 0).alias("publish_dictionary"), F.lit(True).alias("publish_summary"), F.lit(False).alias("recurring"),
        (rk % 3).alias("project_analyst_id"),
    )
    domain = F.when(nk % 3 == 0, "Imaging").when(nk % 3 == 1, "Laboratories").otherwise("Medication")
    dict_table = nation.select(
        nk.alias("id"), F.col("n_regionkey").alias("resource_id"), F.col("n_name").alias("name"), domain.alias("domain"),
        F.concat("n_name", F.lit(" en")).alias("label_en"), F.concat("n_name", F.lit(" fr")).alias("label_fr"),
    )
    earlier = F.filter(F.array(sk - 1, sk - 2), lambda x: x >= 0)
    variable = supplier.join(nation, F.col("s_nationkey") == nk).select(
        sk.alias("id"), F.col("s_nationkey").alias("table_id"), F.col("s_name").alias("name"),
        F.concat_ws(".", "n_name", "s_name").alias("path"), F.lit("string").alias("value_type"),
        F.concat("s_name", F.lit(" fr")).alias("label_fr"), F.concat("s_name", F.lit(" en")).alias("label_en"),
        F.when(sk % 3 != 0, sk % 25).cast("int").alias("value_set_id"),
        earlier.alias("from_variable_id"), F.array((sk % 2).cast("int")).alias("from_source_system_id"),
        F.lit("current").alias("rolling_version"),
    )
    value_set = part.select("p_brand", brand).distinct().select(F.col("value_set_id").alias("id"), F.col("p_brand").alias("name"))
    code = F.concat("p_name", F.lit("#"), "p_partkey")
    value_set_code = part.select(
        F.col("p_partkey").alias("id"), brand, code.alias("code"), F.concat(code, F.lit(" fr")).alias("label_fr"),
        F.concat(code, F.lit(" en")).alias("label_en"),
    )
    mapping = lineitem.select("l_partkey", "l_suppkey").distinct().select(
        F.col("l_partkey").alias("value_set_code_id"), F.col("l_suppkey").cast("string").alias("original_value")
    )
    analyst = region.where(rk < 3).select(rk.alias("id"), F.concat(F.lit("analyst "), "r_name").alias("name"))
    return Catalog(resource, dict_table, variable, value_set, value_set_code, mapping, analyst)


CTES["resource"] = """
    SELECT r_regionkey AS id, lower(r_name) AS code, r_name AS name,
           CASE WHEN r_regionkey < 2 THEN 'source_system' ELSE 'research_project' END AS resource_type,
           'about ' || r_name AS description_en, 'de ' || r_name AS description_fr,
           r_regionkey % 2 = 0 AS publish_dictionary, true AS publish_summary, false AS recurring,
           r_regionkey % 3 AS project_analyst_id
    FROM region
"""
CTES["analyst"] = "SELECT r_regionkey AS id, 'analyst ' || r_name AS name FROM region WHERE r_regionkey < 3"
CTES["dict_table"] = """
    SELECT n_nationkey AS id, n_regionkey AS resource_id, n_name AS name,
           CASE n_nationkey % 3 WHEN 0 THEN 'Imaging' WHEN 1 THEN 'Laboratories' ELSE 'Medication' END AS domain,
           n_name || ' en' AS label_en, n_name || ' fr' AS label_fr
    FROM nation
"""
CTES["variable"] = """
    SELECT s_suppkey AS id, s_nationkey AS table_id, s_name AS name, n_name || '.' || s_name AS path,
           'string' AS value_type, s_name || ' fr' AS label_fr, s_name || ' en' AS label_en,
           CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_suppkey % 25 AS INTEGER) END AS value_set_id,
           list_filter([s_suppkey - 1, s_suppkey - 2], lambda x: x >= 0) AS from_variable_id,
           [CAST(s_suppkey % 2 AS INTEGER)] AS from_source_system_id, 'current' AS rolling_version
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""
CTES["value_set"] = "SELECT DISTINCT CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) % 25 AS id, p_brand AS name FROM part"
CTES["value_set_code"] = """
    SELECT p_partkey AS id, CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) % 25 AS value_set_id,
           p_name || '#' || p_partkey AS code, p_name || '#' || p_partkey || ' fr' AS label_fr,
           p_name || '#' || p_partkey || ' en' AS label_en
    FROM part
"""
CTES["mapping"] = """
    SELECT DISTINCT l_partkey AS value_set_code_id, CAST(l_suppkey AS VARCHAR) AS original_value FROM lineitem
"""
CTES["broken"] = """
    SELECT CASE WHEN original_value = '3' THEN value_set_code_id + 10000000
                WHEN original_value <> '5' THEN value_set_code_id END AS value_set_code_id, original_value
    FROM mapping
"""
CTES["parents"] = """
    SELECT v.id AS var_id, p.id AS parent_id, p.name AS parent_name, coalesce(r.publish_dictionary, false) AS published
    FROM (SELECT id, unnest(from_variable_id) AS parent_id FROM variable) v
    JOIN variable p ON p.id = v.parent_id
    LEFT JOIN dict_table t ON t.id = p.table_id LEFT JOIN resource r ON r.id = t.resource_id
"""
CTES["systems"] = """
    SELECT v.id AS var_id, r.id AS rs_id, r.code AS rs_code, r.publish_dictionary AS published
    FROM (SELECT id, unnest(from_source_system_id) AS rs FROM variable) v JOIN resource r ON r.id = v.rs
"""
CTES["lineage"] = """
    SELECT v.id AS var_id, v.name AS var_name,
           coalesce(p.n, 0) AS n_parents, coalesce(p.parents, '') AS parents, coalesce(s.n, 0) AS n_systems,
           coalesce(s.systems, '') AS systems
    FROM variable v
    LEFT JOIN (SELECT var_id, count(*) AS n,
                      string_agg(parent_id || ':' || parent_name || ':' || published, ',' ORDER BY parent_id) AS parents
               FROM parents GROUP BY 1) p ON p.var_id = v.id
    LEFT JOIN (SELECT var_id, count(*) AS n,
                      string_agg(rs_id || ':' || rs_code || ':' || published, ',' ORDER BY rs_id) AS systems
               FROM systems GROUP BY 1) s ON s.var_id = v.id
"""
CTES["counts"] = """
    SELECT r.id AS rs_id,
           (SELECT count(DISTINCT t2.resource_id) FROM dict_table t2 JOIN variable v2 ON v2.table_id = t2.id
              JOIN resource r2 ON r2.id = t2.resource_id
              WHERE r2.resource_type = 'research_project' AND list_contains(v2.from_source_system_id, r.id)) AS project_count,
           (SELECT count(DISTINCT domain) FROM dict_table t WHERE t.resource_id = r.id) AS domain_count,
           (SELECT count(DISTINCT x) FROM (SELECT unnest(v.from_source_system_id) AS x FROM variable v
              JOIN dict_table t ON t.id = v.table_id WHERE t.resource_id = r.id)) AS source_system_count,
           (SELECT count(*) FROM variable v JOIN dict_table t ON t.id = v.table_id WHERE t.resource_id = r.id) AS variable_count,
           (SELECT count(*) FROM dict_table t WHERE t.resource_id = r.id) AS table_count
    FROM resource r
"""
CTES["africa_tables"] = """
    SELECT t.* FROM dict_table t JOIN resource r ON t.resource_id = r.id WHERE r.code = 'africa' AND r.publish_dictionary
"""
CTES["africa_variables"] = "SELECT v.* FROM variable v JOIN africa_tables t ON t.id = v.table_id"

# ---------------------------------------------------------------- events, customers

ANCHOR = "2024-01-03 03:00:00"
COHORT_SEGMENT = "BUILDING"


def cohort(spark: SparkSession, sf: str, key: str) -> DataFrame:
    customers = table(spark, sf, "customer").where(F.col("c_mktsegment") == COHORT_SEGMENT)
    return customers.select(F.col("c_custkey").alias(key))


CTES["cohort"] = "SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'"


def form_captures(spark: SparkSession, sf: str) -> DataFrame:
    """One row per captured field; every fourth document has its status captured again a day later."""
    orders = table(spark, sf, "orders")
    base = orders.select(
        F.col("o_orderkey").alias("doc"), F.col("o_orderpriority").alias("form"),
        F.col("o_orderstatus").alias("status"), F.col("o_custkey").cast("string").alias("custkey"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string").alias("price_cents"), F.col("o_orderdate").alias("ts"),
    )
    first = base.unpivot(["doc", "form", "ts"], ["status", "custkey", "price_cents"], "field", "value")
    later = base.where(F.col("doc") % 4 == 0).select(
        "doc", "form", (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"), F.lit("status").alias("field"), F.lit("X").alias("value")
    )
    return first.unionByName(later)


CTES["captures"] = """
    SELECT o_orderkey AS doc, o_orderpriority AS form, o_orderdate AS ts, 'status' AS field, o_orderstatus AS value FROM orders
    UNION ALL SELECT o_orderkey, o_orderpriority, o_orderdate, 'custkey', CAST(o_custkey AS VARCHAR) FROM orders
    UNION ALL SELECT o_orderkey, o_orderpriority, o_orderdate, 'price_cents',
                     CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) FROM orders
    UNION ALL SELECT o_orderkey, o_orderpriority, o_orderdate + INTERVAL 1 DAY, 'status', 'X' FROM orders WHERE o_orderkey % 4 = 0
"""


def snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A source and a destination with more nulls in one dataset and fewer rows in another."""
    events = table(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    eid, kind = F.col("event_id"), F.col("event_type")
    source = events.withColumn("value", F.when(eid % 10 != 0, F.col("value")))
    gone = (kind == "view") & (eid % 100 == 0)
    hidden = (kind == "error") & (eid % 7 == 0)
    return source, source.where(~gone).withColumn("value", F.when(~hidden, F.col("value")))


CTES["snap_source"] = """
    SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 10 <> 0 THEN value END AS value, props,
           strftime(ts, '%Y-%m-%d') AS day FROM events
"""
CTES["snap_destination"] = """
    SELECT event_id, ts, user_id, event_type,
           CASE WHEN NOT (event_type = 'error' AND event_id % 7 = 0) THEN value END AS value, props, day
    FROM snap_source WHERE NOT (event_type = 'view' AND event_id % 100 = 0)
"""
