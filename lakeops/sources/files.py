"""Readers of single files: listings, cohort lists, manifests, compressed objects."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.functions.objects import inflated
from lakeops.functions.studies import exam_date, exam_date_problem, study_path
from lakeops.sources.listing import place_of, walk_files
from lakeops.sources.store import Store

# Cell contents a cohort list treats as missing.
COHORT_NA = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

#: Bytes of objects that a task holds before it hands them on.
OPEN_BYTES = 2 << 20


def list_files(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """``(path, size)`` of every file below a folder; contents are not read.

    Tasks list (``listing.walk_files``). Only where Arrow cannot reach the storage does Spark's file index do
    it, which holds the listing in the driver.
    """
    roots = [path] if isinstance(path, str) else path
    try:
        for root in roots:
            place_of(Store(spark).qualified(root))
    except (pa.ArrowInvalid, OSError):
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        if glob:
            reader = reader.option("pathGlobFilter", glob)
        return reader.load(path).select("path", F.col("length").alias("size"))
    return walk_files(spark, roots, glob)


def first_lines(files: DataFrame) -> DataFrame:
    """First line of each file, read by the tasks that hold the listing."""

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = []
            for uri in batch["path"]:
                where, path, _ = place_of(uri)
                line = b""
                with where.open_input_stream(path) as stream:
                    while b"\n" not in line:
                        more = stream.read(65536)
                        if not more:
                            break
                        line += more
                lines.append(line.split(b"\n", 1)[0].rstrip(b"\r").decode("utf-8-sig"))
            yield pd.DataFrame({"path": batch["path"], "first_line": lines})

    return files.select("path").mapInPandas(probe, "path string, first_line string")


def relative_to(c, root: str):
    """Part of a file URI after the folder ``root``, whatever scheme the listing shows."""
    bare = root.split("://", 1)[-1].removeprefix("file:").strip("/")
    return F.element_at(F.split(c, f"\\Q/{bare}/\\E", 2), -1)


def list_objects(spark: SparkSession, root: str) -> DataFrame:
    """Objects below a prefix with their size, folder markers left out."""
    listing = list_files(spark, root)
    return listing.where(~F.col("path").endswith("/")).withColumn("key", relative_to(F.col("path"), root))


def read_objects(spark: SparkSession, root: str) -> DataFrame:
    """Object contents; ``.cmp`` payloads are inflated and lose that suffix.

    The tasks that open objects are dealt the listing, which the driver never holds. A payload that cannot
    be inflated keeps a null content and an error instead of failing the scan. A task holds the contents of
    a few megabytes of objects, or of one that is larger.
    """
    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held):
            keys, contents, errors = zip(*held)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(contents, pa.binary()), pa.array(errors, pa.string())], ["key", "content", "error"])

        held, size = [], 0
        for batch in batches:
            for uri, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                where, path, _ = place_of(uri)
                with where.open_input_file(path) as stream:
                    content, error = stream.read(), None
                if key.endswith(".cmp"):
                    key = key.removesuffix(".cmp")
                    content, error = inflated(content)
                held.append((key, content, error))
                size += len(content or b"")
                if size >= OPEN_BYTES or len(held) >= 1000:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    listing = list_objects(spark, root).select("path", "key")
    tasks = spark.sparkContext.defaultParallelism * 4
    return listing.repartition(tasks, "path").mapInArrow(opened, "key string, content binary, error string")


def read_cohort(spark: SparkSession, path: str, accession: str, exam: str, parent: str) -> DataFrame:
    """Study patterns of a cohort list, with ``reject_reason`` for dates that are not ``Y-M-D``.

    Every cell is text, so leading zeros survive; rows missing either value are dropped.
    """
    rows = (
        spark.read.option("header", True).option("escape", '"').option("multiLine", False).csv(path)
    )
    absent = [c for c in (accession, exam) if c not in rows.columns]
    if absent:
        raise ValueError(f"{path} has no column {absent}; its columns are {rows.columns}")
    known = [F.when(~F.col(c).isin(COHORT_NA), F.col(c)).alias(c) for c in (accession, exam)]
    rows = rows.select(*known).na.drop("any")
    day = exam_date(F.col(exam))
    return rows.select(
        F.col(accession).alias("accession"),
        F.col(exam).alias("exam_date_text"),
        exam_date_problem(F.col(exam)).alias("reject_reason"),
        F.when(day.isNotNull(), study_path(F.lit(parent), day, F.trim(F.col(accession)))).alias("pattern"),
    )


def read_manifests(spark: SparkSession, root: str, days: list[str] | None, schema: str) -> DataFrame | None:
    """Rows of the ``*.idx`` manifests of the given ``yyyy/MM/dd`` folders, or of every day.

    ``None`` when no manifest exists: the caller then writes nothing.
    """
    store = Store(spark)
    folders = [root] if days is None else [p for p in (f"{root}/{d}" for d in days) if store.exists(p)]
    if not folders:
        return None
    found = (
        spark.read.schema(schema).option("header", True)
        .option("pathGlobFilter", "*.idx").option("recursiveFileLookup", True)
        .csv(folders)
        .withColumn("manifest", F.col("_metadata.file_path"))
    )
    return None if list_files(spark, folders, "*.idx").where("size > 0").isEmpty() else found


def read_messages(messages: DataFrame, body: str, keep: list[str]) -> DataFrame:
    """One row per segment of pipe-delimited messages: segment name, ordinal, fields."""
    lines = messages.select(*keep, F.posexplode(F.split(F.col(body), "\r")).alias("ordinal", "line"))
    fields = F.split("line", r"\|")
    return (
        lines.where(F.col("line") != "")
        .select(*keep, "ordinal", fields.alias("fields"))
        .withColumn("segment", F.element_at("fields", 1))
    )
