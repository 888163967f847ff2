"""Document queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeops.checks import fixtures as fx
from lakeops.checks.base import query, staged
from lakeops.functions.documents import day_prefix, sanitize_id, tree_path, uri_bucket, uri_key
from lakeops.operators.documents import (
    REPORT_COLUMNS, decode_documents, extracted_tables, parse_counters, parse_documents, skipped_documents, union_outcomes,
)
from lakeops.plans.document_job import run_document_job
from lakeops.session import scratch_dir
from lakeops.sinks.window import overwrite_window
from lakeops.sources.files import list_objects
from lakeops.sources.tables import list_partitions, partitioned_table, read_window

TABLES_TEMPLATE = "intake/parsed/{{date}}/{{hl7_id}}/table_{{table_no}}.csv"
REPORT_TEMPLATE = "intake/parsed/{{date}}/{{hl7_id}}/report.md"
COLUMNS = ["hl7_id", "observation_value_base64", "dte_of_message"]


def _documents(spark, sf, start=fx.FIRST_DAY, end=fx.LAST_DAY):
    source = partitioned_table(spark, fx.obx_table(spark, sf), "dte_of_message")
    return read_window(source, COLUMNS, "dte_of_message", start, end)


def _decoded(spark, sf, *window):
    return decode_documents(_documents(spark, sf, *window), "observation_value_base64")


def _parsed(spark, sf, *window):
    return parse_documents(_decoded(spark, sf, *window), fx.line_parser)


def _report(spark, sf, *window):
    return _parsed(spark, sf, *window).select(*REPORT_COLUMNS)


def parsed_path(spark, sf):
    """Parsed documents in storage; a parser runs once however many outputs follow."""
    return staged(spark, sf, "parsed", lambda path: _parsed(spark, sf).write.parquet(path))


@query("s3_partition_window", """
    SELECT hl7_id, dte_of_message,
           CASE WHEN k = 3 THEN 7 ELSE length(to_base64(encode(body))) END AS payload_chars
    FROM obx WHERE dte_of_message >= '2024-01-05' AND dte_of_message < '2024-01-20'
""", ("obx",))
def s3_partition_window(spark, sf):
    chars = F.length(F.regexp_replace("observation_value_base64", r"\s", "")).cast("bigint")
    return _documents(spark, sf, *fx.WINDOW).select("hl7_id", "dte_of_message", chars.alias("payload_chars"))


@query("s4_list_partitions", """
    SELECT DISTINCT dte_of_message FROM obx
    WHERE dte_of_message >= '2024-01-05' AND dte_of_message < '2024-01-20' ORDER BY 1
""", ("obx",))
def s4_list_partitions(spark, sf):
    source = partitioned_table(spark, fx.obx_table(spark, sf), "dte_of_message")
    return list_partitions(source, "dte_of_message", *fx.WINDOW)


@query("p4_tree_path", r"""
    SELECT hl7_id, regexp_replace(hl7_id, '[^A-Za-z0-9._]', '_', 'g') AS safe_id,
           'intake/parsed/' || replace(dte_of_message, '-', '/') || '/' || safe_id || '/table_2.csv' AS table_path,
           'intake/parsed/' || replace(dte_of_message, '-', '/') || '/' || safe_id || '/report.md' AS report_path,
           'intake/parsed/' || replace(dte_of_message, '-', '/') || '/' || safe_id || '/table_{{table_no}}.csv' AS open_path,
           'intake/parsed/' || replace(dte_of_message, '-', '/') AS day_prefix,
           'vault-1' AS bucket, 'intake/parsed/' || safe_id AS key
    FROM obx
""", ("obx",))
def p4_tree_path(spark, sf):
    day = F.concat("dte_of_message", F.lit("T10:00:00"))
    doc, template = F.col("hl7_id"), F.lit(TABLES_TEMPLATE)
    uri = F.concat(F.lit("s3://vault-1/intake/parsed/"), sanitize_id(doc), F.lit("/"))
    return fx.obx(spark, sf).select(
        "hl7_id", sanitize_id(doc).alias("safe_id"),
        tree_path(template, day, doc, F.lit(2)).alias("table_path"),
        tree_path(F.lit(REPORT_TEMPLATE), day, doc).alias("report_path"),
        tree_path(template, day, doc, F.lit(None).cast("int")).alias("open_path"),
        day_prefix(template, day).alias("day_prefix"),
        uri_bucket(uri).alias("bucket"), uri_key(uri).alias("key"),
    )


@query("p6_sniff_decode", """
    SELECT hl7_id, dte_of_message, source_format,
           CASE WHEN source_format <> 'pdf' THEN 'skipped' END AS parse_status,
           CASE WHEN body IS NULL THEN 'base64 decode: invalid payload'
                WHEN source_format <> 'pdf' THEN 'unsupported format: ' || source_format END AS parse_error,
           octet_length(encode(body)) AS n_bytes, md5(body) AS digest
    FROM decoded
""", ("obx", "decoded"))
def p6_sniff_decode(spark, sf):
    return _decoded(spark, sf).select(
        "hl7_id", "dte_of_message", "source_format", "parse_status", "parse_error",
        F.length("raw").cast("bigint").alias("n_bytes"), F.md5("raw").alias("digest"),
    )


@query("u1_parse_documents", """
    SELECT o.hl7_id, o.dte_of_message, parse_status, parse_error, md5(report_markdown) AS digest,
           coalesce(t.n, 0) AS n_tables, coalesce(t.n_cols, 0) AS n_cols
    FROM outcomes o LEFT JOIN (
        SELECT hl7_id, count(*) AS n,
               CAST(sum(len(list_filter(string_split(table_csv, ' '), lambda x: x <> ''))) AS BIGINT) AS n_cols
        FROM doc_tables GROUP BY 1) t ON t.hl7_id = o.hl7_id
    WHERE parse_status <> 'skipped'
""", ("obx", "decoded", "outcomes", "doc_tables"))
def u1_parse_documents(spark, sf):
    total = F.aggregate("tables", F.lit(0).cast("bigint"), lambda a, t: a + t["n_cols"])
    return _parsed(spark, sf).where("parse_status <> 'skipped'").select(
        "hl7_id", "dte_of_message", "parse_status", "parse_error", F.md5("report_markdown").alias("digest"),
        F.size("tables").cast("bigint").alias("n_tables"), total.alias("n_cols"),
    )


@query("so2_union_outcomes", """
    SELECT hl7_id, dte_of_message, md5(report_markdown) AS report_digest, source_format, parse_status, parse_error FROM outcomes
""", ("obx", "decoded", "outcomes"))
def so2_union_outcomes(spark, sf):
    decoded = _decoded(spark, sf)
    pdfs = parse_documents(decoded.where(F.col("parse_status").isNull()), fx.line_parser)
    return union_outcomes(pdfs, skipped_documents(decoded)).select(
        "hl7_id", "dte_of_message", F.md5("report_markdown").alias("report_digest"), "source_format", "parse_status", "parse_error"
    )


@query("w6_item_ordinals", """
    SELECT hl7_id, dte_of_message, table_index, table_csv, CAST(1 AS BIGINT) AS n_rows,
           CAST(len(list_filter(string_split(table_csv, ' '), lambda x: x <> '')) AS BIGINT) AS n_cols,
           CAST(NULL AS BIGINT) AS page_no
    FROM doc_tables
""", ("obx", "decoded", "outcomes", "doc_tables"))
def w6_item_ordinals(spark, sf):
    return extracted_tables(_parsed(spark, sf))


@query("g2_parse_counters", """
    SELECT dte_of_message, count(*) AS rows_read, count(*) FILTER (parse_status <> 'skipped') AS pdfs_parsed,
           count(*) FILTER (parse_status = 'skipped') AS skipped,
           CAST(sum(coalesce(t.n, 0)) AS BIGINT) AS tables_extracted, count(report_markdown) AS reports_written,
           count(DISTINCT dte_of_message) AS dates
    FROM (SELECT o.*, t.n FROM outcomes o LEFT JOIN (SELECT hl7_id, count(*) AS n FROM doc_tables GROUP BY 1) t USING (hl7_id)) t
    GROUP BY ROLLUP (dte_of_message)
""", ("obx", "decoded", "outcomes", "doc_tables"))
def g2_parse_counters(spark, sf):
    return parse_counters(_parsed(spark, sf).withColumn("n_tables", F.size("tables")))


@query("k1_overwrite_window", """
    SELECT hl7_id, dte_of_message, md5(report_markdown) AS report_digest, source_format, parse_status, parse_error FROM outcomes
    WHERE dte_of_message >= '2024-01-05' AND dte_of_message < '2024-01-20' AND dte_of_message <> '2024-01-11'
    UNION ALL
    SELECT hl7_id, dte_of_message, NULL, source_format, 'old', NULL FROM outcomes
    WHERE NOT (dte_of_message >= '2024-01-05' AND dte_of_message < '2024-01-20')
""", ("obx", "decoded", "outcomes"))
def k1_overwrite_window(spark, sf):
    """An older report covers every day; the window is replaced, one of its days no longer exists."""
    path = scratch_dir(spark, "report")
    empty = F.lit(None).cast("string")
    old = _decoded(spark, sf).select(
        "hl7_id", "dte_of_message", empty.alias("report_markdown"), "source_format",
        F.lit("old").alias("parse_status"), empty.alias("parse_error"),
    )
    overwrite_window(old, path, "dte_of_message", fx.FIRST_DAY, fx.LAST_DAY)
    new = _report(spark, sf, *fx.WINDOW).where(F.col("dte_of_message") != "2024-01-11")
    overwrite_window(new, path, "dte_of_message", *fx.WINDOW)
    return partitioned_table(spark, path, "dte_of_message").select(
        "hl7_id", "dte_of_message", F.md5("report_markdown").alias("report_digest"), "source_format", "parse_status", "parse_error"
    )


@query("k4_keyed_tree", r"""
    SELECT 'intake/parsed/' || replace(dte_of_message, '-', '/') || '/' || regexp_replace(hl7_id, '[^A-Za-z0-9._]', '_', 'g')
           || '/table_' || table_index || '.csv' AS path, octet_length(encode(table_csv)) AS n_bytes
    FROM doc_tables
    UNION ALL
    SELECT 'intake/parsed/' || replace(dte_of_message, '-', '/') || '/' || regexp_replace(hl7_id, '[^A-Za-z0-9._]', '_', 'g')
           || '/report.md', octet_length(encode(report_markdown))
    FROM outcomes WHERE report_markdown IS NOT NULL
""", ("obx", "decoded", "outcomes", "doc_tables"))
def k4_keyed_tree(spark, sf):
    """The document job over every day, from stored documents to report and tree; what storage then holds."""
    root = scratch_dir(spark, "tree")
    run_document_job(
        spark, fx.obx_table(spark, sf), scratch_dir(spark, "job-report"), root, TABLES_TEMPLATE, REPORT_TEMPLATE,
        fx.FIRST_DAY, fx.LAST_DAY, fx.line_parser)
    return list_objects(spark, root).select(F.col("key").alias("path"), F.col("size").alias("n_bytes"))
