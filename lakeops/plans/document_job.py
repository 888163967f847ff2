"""The document job: a window of base64 documents becomes a report, tables and one folder per document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.operators.documents import (
    REPORT_COLUMNS, Parser, decode_documents, parse_counters, parse_documents, tree_files,
)
from lakeops.functions.documents import day_prefix
from lakeops.session import durable, forget
from lakeops.sinks.tree import replace_day_folders
from lakeops.sinks.window import overwrite_window
from lakeops.sources.tables import partitioned_table, read_window

COLUMNS = ["hl7_id", "observation_value_base64", "dte_of_message"]


def run_document_job(
    spark: SparkSession, source: str, report: str, tree: str, tables_template: str, report_template: str,
    start: str, end: str, make_parser: Callable[[], Parser], tasks: int | None = None, limit_seconds: float | None = None,
) -> DataFrame:
    """Parse the documents of ``[start, end)`` and replace that window in every output.

    One job covers the window. Parsing is the costly step, so its result is materialized once and all
    outputs are made from it, and dropped at the end. All outputs are replaced over the whole window: a
    day that has vanished from the source vanishes from the report and from the tree as well. ``tasks``
    spreads the documents by id over that many tasks, for a parser so slow that the scan's own splits
    would run for hours; ``limit_seconds`` bounds what one document may take. Returns the counters per
    day and in total.
    """
    documents = read_window(partitioned_table(spark, source, "dte_of_message"), COLUMNS, "dte_of_message", start, end)
    if tasks:
        documents = documents.repartition(tasks, "hl7_id")
    parsed = durable(parse_documents(decode_documents(documents, "observation_value_base64"), make_parser, limit_seconds))
    day = F.explode(F.expr(f"sequence(DATE '{start[:10]}', DATE '{end[:10]}' - INTERVAL 1 DAY)")).alias("day")
    both = F.explode(F.array(*[day_prefix(F.lit(t), F.col("day").cast("string")) for t in (tables_template, report_template)])).alias("folder")
    folders = [r.folder for r in spark.range(1).select(day).select(both).distinct().collect()]  # one row per day of the window
    overwrite_window(parsed.select(*REPORT_COLUMNS), report, "dte_of_message", start, end)
    replace_day_folders(tree_files(parsed, tables_template, report_template), tree, sorted(folders))
    counters = durable(parse_counters(parsed.withColumn("n_tables", F.size("tables"))))
    forget(parsed)
    return counters
