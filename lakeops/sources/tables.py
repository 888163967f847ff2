"""Readers of tabular datasets: partition windows, directory unions, daily slices."""

from __future__ import annotations

import csv
import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lakeops.session import durable
from lakeops.sources.files import first_lines, list_files
from lakeops.sources.registry import union_by_name
from lakeops.sources.store import Store


def check_window(start: str, end: str) -> None:
    """A window is half-open and must hold at least one day."""
    if start >= end:
        raise ValueError(f"empty window [{start}, {end})")


def in_window(column: str, start: str, end: str):
    return (F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end))


def partitioned_table(spark: SparkSession, path: str, partition: str) -> DataFrame:
    """A parquet table whose partition column is read back as the string it was written as."""
    df = spark.read.parquet(path)
    if dict(df.dtypes)[partition] == "string":
        return df
    # Folder names such as 2024-01-01 are inferred as dates unless the schema says otherwise.
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([
        StructField(f.name, StringType() if f.name == partition else f.dataType) for f in df.schema
    ])
    return spark.read.schema(schema).parquet(path)


def read_window(table: DataFrame, columns: list[str], partition: str, start: str, end: str) -> DataFrame:
    """Chosen columns of the partitions in ``[start, end)``; the predicate prunes folders."""
    check_window(start, end)
    return table.where(in_window(partition, start, end)).select(*columns)


def list_partitions(table: DataFrame, partition: str, start: str, end: str) -> DataFrame:
    """Distinct partition values of the window, ascending; no data column is decoded."""
    check_window(start, end)
    return table.select(partition).where(in_window(partition, start, end)).distinct().orderBy(partition)


def read_parquet_dir(spark: SparkSession, path: str) -> DataFrame:
    """Every ``*.parquet`` file below a folder, columns united by name."""
    folder = path if path.endswith("/") else f"{path}/"
    names = spark.read.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
    try:
        return names.option("mergeSchema", True).parquet(folder)
    except Exception as error:
        if any(tag in str(error) for tag in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND")):
            raise FileNotFoundError(f"no parquet file under {folder}") from error
        raise


def read_csv_dir(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Every ``*.csv`` file below a folder, columns united by header name; all of them text.

    Tasks read the header line of each file, and only the distinct ones reach the driver. There is one
    scan per distinct header, which keeps the rows of the files that have it; with one header, the
    usual case, nothing is joined.
    """
    folder = path if path.endswith("/") else f"{path}/"
    if not Store(spark).exists(folder):
        raise FileNotFoundError(f"no csv file under {folder}")
    lines = first_lines(list_files(spark, folder, "*.csv").where("size > 0"))
    headers = sorted(r.first_line for r in lines.select("first_line").distinct().collect())
    if not headers:
        raise FileNotFoundError(f"no csv file under {folder}")
    if len(headers) > 1:
        lines = durable(lines)
    frames = []
    for header in headers:
        names = next(csv.reader([header], delimiter=options.get("sep", ",")), [])
        schema = StructType([StructField(n, StringType()) for n in names])
        reader = spark.read.schema(schema).option("header", True).options(**options)
        rows = reader.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).csv(folder)
        if len(headers) > 1:
            own = lines.where(F.col("first_line") == header).select(F.col("path").alias("_own"))
            file = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
            rows = rows.withColumn("_file", file).join(own, F.col("_file") == F.col("_own"), "left_semi").drop("_file")
        frames.append(rows)
    return union_by_name(frames)


def rename_header(df: DataFrame, header: list[str] | None) -> DataFrame:
    """Positional override of the column names; the lengths must agree."""
    if header is None:
        return df
    if len(header) != len(df.columns):
        raise ValueError(f"header has {len(header)} names, table has {len(df.columns)} columns")
    return df.toDF(*header)


def daily_slice(df: DataFrame, ts: str, run_date: str, lag_days: int) -> DataFrame:
    """Rows of the calendar day ``run_date - lag_days``, as a range test that reaches the scan."""
    day = dt.date.fromisoformat(run_date) - dt.timedelta(days=lag_days)
    after = day + dt.timedelta(days=1)
    lo, hi = (F.expr(f"TIMESTAMP_NTZ '{d.isoformat()} 00:00:00'") for d in (day, after))
    return df.where((F.col(ts) >= lo) & (F.col(ts) < hi))
