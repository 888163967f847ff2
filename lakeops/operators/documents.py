"""Parsing jobs over base64 documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.functions.documents import (
    base64_padding, document_format, lenient_base64, padded_enough, strict_base64, tree_path,
)
from lakeops.operators.once import evaluate_once
from lakeops.operators.supervised import Supervised
from lakeops.session import small_batches

# Columns of the two outputs, and the statuses and errors found in them.
REPORT_SCHEMA = (
    "hl7_id string, dte_of_message string, report_markdown string, source_format string, "
    "parse_status string, parse_error string"
)
TABLE_SCHEMA = (
    "hl7_id string, dte_of_message string, table_index bigint, table_csv string, "
    "n_rows bigint, n_cols bigint, page_no bigint"
)
PARSED = ["success", "partial_success"]
PARSE_FAILED = "docling conversion failed"

REPORT_COLUMNS = [part.split()[0] for part in REPORT_SCHEMA.split(", ")]
_PARSED_SCHEMA = (
    f"{REPORT_SCHEMA}, tables array<struct<table_csv: string, n_rows: bigint, n_cols: bigint, page_no: bigint>>"
)

# A parser takes (document id, bytes) and returns status, markdown and tables (csv, rows, columns, page).
Parser = Callable[[str, bytes], dict[str, Any]]


def decode_documents(df: DataFrame, payload: str) -> DataFrame:
    """Replace the payload by its bytes and say what can be parsed.

    ``parse_status`` is null for the PDFs that go on to the parser and ``skipped`` for the rest.
    """
    c, strict, padding = F.col(payload), F.col("_strict"), F.col("_padding")
    read = evaluate_once(df, _strict=strict_base64(c), _padding=base64_padding(c))
    decoded = F.when(strict.isNull(), lenient_base64(c, padding)).when(padded_enough(strict, padding), strict)
    raw = evaluate_once(read, raw=decoded).drop("_strict", "_padding", payload)
    absent = F.col("raw").isNull()
    told = evaluate_once(raw, source_format=F.when(absent, "other").otherwise(document_format(F.col("raw"))))
    fmt = F.col("source_format")
    problem = F.when(absent, "base64 decode: invalid payload").when(
        fmt != "pdf", F.concat(F.lit("unsupported format: "), fmt)
    )
    return told.withColumn("parse_status", F.when(fmt != "pdf", "skipped")).withColumn("parse_error", problem)


def parse_documents(decoded: DataFrame, make_parser: Callable[[], Parser], limit_seconds: float | None = None) -> DataFrame:
    """One row per document: the report columns and the tables found in it.

    Skipped documents pass through in the same scan and their bytes never reach Python.
    ``make_parser`` runs once per task, so a costly model is loaded once. A document that raises or
    ends in any status but success is reported and never fails its batch. With ``limit_seconds`` the
    parser runs in a process of its own; a document that takes longer is a failure, the process is ended
    and the next document gets a new one. A batch of documents is bounded in bytes.
    """
    small_batches(decoded.sparkSession)

    def unpack(result):
        status = str(result["status"])
        if status not in PARSED:
            return status, None, []
        tables = [
            {"table_csv": str(csv), "n_rows": int(n_rows), "n_cols": int(n_cols), "page_no": None if page is None else int(page)}
            for csv, n_rows, n_cols, page in result.get("tables") or []
        ]
        return status, str(result["markdown"]), tables

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = Supervised(make_parser, limit_seconds) if limit_seconds else make_parser()
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                if row.parse_status is not None:
                    rows.append((row.hl7_id, row.dte_of_message, None, row.source_format, row.parse_status, row.parse_error, []))
                    continue
                try:
                    status, markdown, tables = unpack(parser(row.hl7_id, bytes(row.raw)))
                except Exception:  # a bad document, or a bad result for it, stays its own problem
                    status, markdown, tables = "failure", None, []
                problem = None if status in PARSED else PARSE_FAILED
                rows.append((row.hl7_id, row.dte_of_message, markdown, row.source_format, status, problem, tables))
            yield pd.DataFrame(rows, columns=[*REPORT_COLUMNS, "tables"])
        if limit_seconds:
            parser.close()

    payload = F.when(F.col("parse_status").isNull(), F.col("raw")).alias("raw")
    given = decoded.select("hl7_id", "dte_of_message", payload, "source_format", "parse_status", "parse_error")
    return given.mapInPandas(parse, _PARSED_SCHEMA)


def skipped_documents(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("parse_status") == "skipped").select(
        "hl7_id", "dte_of_message", F.lit(None).cast("string").alias("report_markdown"),
        "source_format", "parse_status", "parse_error",
    )


def union_outcomes(parsed: DataFrame, skipped: DataFrame) -> DataFrame:
    """Skipped and parsed documents, obtained apart, in one report with fixed columns and types."""
    return skipped.select(*REPORT_COLUMNS).unionByName(parsed.select(*REPORT_COLUMNS))


def extracted_tables(parsed: DataFrame) -> DataFrame:
    """Tables numbered from zero within their document."""
    return parsed.select(
        "hl7_id", "dte_of_message", F.posexplode("tables").alias("pos", "t")
    ).select(
        "hl7_id", "dte_of_message", F.col("pos").cast("bigint").alias("table_index"),
        "t.table_csv", "t.n_rows", "t.n_cols", "t.page_no",
    )


def parse_counters(outcomes: DataFrame) -> DataFrame:
    """Counts per day and, on the row with a null day, over the window with its number of days.

    ``outcomes`` is the report with ``n_tables``, the number of tables of each document.
    """
    per_day = outcomes.groupBy("dte_of_message").agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(F.col("parse_status") != "skipped").alias("pdfs_parsed"),
        F.count_if(F.col("parse_status") == "skipped").alias("skipped"),
        F.sum(F.coalesce(F.col("n_tables"), F.lit(0)).cast("bigint")).alias("tables_extracted"),
        F.count("report_markdown").alias("reports_written"),
    )
    names = ["rows_read", "pdfs_parsed", "skipped", "tables_extracted", "reports_written"]
    # The day grain is a few rows by now; the total line rolls it up without another pass.
    return per_day.rollup("dte_of_message").agg(
        *[F.sum(n).alias(n) for n in names], F.count(F.lit(1)).alias("dates")
    )


def tree_files(parsed: DataFrame, tables_template: str, report_template: str) -> DataFrame:
    """``(path, day, content)`` of every file a set of parsed documents is published as."""
    day, doc = F.col("dte_of_message"), F.col("hl7_id")
    tables = extracted_tables(parsed).select(
        tree_path(F.lit(tables_template), day, doc, F.col("table_index")).alias("path"),
        day.alias("day"), F.col("table_csv").alias("content"),
    )
    reports = parsed.where(F.col("report_markdown").isNotNull()).select(
        tree_path(F.lit(report_template), day, doc).alias("path"),
        day.alias("day"), F.col("report_markdown").alias("content"),
    )
    return tables.unionByName(reports)
