"""Versioned releases and their publication."""

from __future__ import annotations

import datetime as dt
import re
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.functions.text import strip_illegal
from lakeops.operators.catalog import TIMES, in_shares, _repeat
from lakeops.session import durable, forget, small_batches
from lakeops.sources.listing import place_of
from lakeops.sources.registry import Registry
from lakeops.sources.store import Store
from lakeops.sources.tables import read_csv_dir, read_parquet_dir, rename_header

# Fixed value: the alias of the newest release.
LATEST = "latest"

# Rows that a spreadsheet holds below its header.
SHEET_ROWS = 1_048_575

# How sheets of a dictionary are quoted.
_CSV = {"escape": '"'}

# Bytes of text that one task writes, that are compressed or looked through at once, and of compressed text that are inflated at once.
_TASK, _BLOCK, _INFLATE = 1 << 28, 1 << 17, 1 << 10
_ROWS = 20_000


def check_version(version: str) -> str:
    """``latest`` or a date written ``YYYY-MM-DD``."""
    if version != LATEST:
        if not version:
            raise ValueError("a version is needed: 'latest' or YYYY-MM-DD")
        try:
            dt.datetime.strptime(version, "%Y-%m-%d")
        except ValueError:
            raise ValueError(f"{version!r} is no version: use 'latest' or YYYY-MM-DD") from None
    return version


def release_version(requested: str, interval_end: str, pass_date: bool, underscore: bool = False) -> str:
    """Version a run writes: the date asked for, else the end of its interval, else ``latest``."""
    version = check_version(requested)
    if version == LATEST and pass_date:
        version = interval_end[:10]
    return version.replace("-", "_") if underscore else version


def release_path(base: str, resource: str, version: str, table: str) -> str:
    return f"{base.rstrip('/')}/released/{resource}/{version}/{table}"


def release_table(df: DataFrame, base: str, resource: str, version: str, table: str) -> str:
    """Write a table of a release; an earlier one under the same version stays until the new one is whole."""
    path = release_path(base, resource, check_version(version), table)
    store = Store(df.sparkSession)
    staged = f"{base.rstrip('/')}/_staged/{resource}/{version}/{table}"
    df.write.mode("overwrite").parquet(staged)
    store.swap(path, staged)
    df.sparkSession.catalog.refreshByPath(path)
    return path


def released_tables(spark: SparkSession, base: str, resource: str, version: str) -> list[str]:
    """Tables of a release, from folder names. A release that stopped half-way is put right first."""
    folder, store = f"{base.rstrip('/')}/released/{resource}/{version}", Store(spark)
    for e in store.children(folder):
        if e.name.endswith("__retired"):
            store.recover(e.path.removesuffix("__retired"))
    return [e.name for e in store.children(folder) if e.is_dir]


def output_path(template: Column, version: Column, bucket: Column, default_bucket: str) -> Column:
    """Path a table is published at, without extension.

    ``_{{version}}`` is filled first with underscores, what is left of ``{{version}}`` with dashes. The
    default bucket publishes below a folder.
    """
    path = F.replace(template, F.lit("_{{version}}"), F.concat(F.lit("_"), F.replace(version, F.lit("-"), F.lit("_"))))
    path = F.replace(path, F.lit("{{version}}"), version)
    return F.when(bucket == default_bucket, F.concat(F.lit("published"), path)).otherwise(path)


def publication_plan(
    spark: SparkSession, registry: Registry, base: str, resource: str, version: str, default_bucket: str,
) -> DataFrame:
    """One row per released table: where it is read and where it is published."""
    rows = []
    for table in released_tables(spark, base, resource, version):
        dataset = registry.select([f"published_{resource}_{table}"])[0]
        rows.append((table, release_path(base, resource, version, table), registry.bucket(dataset.id), dataset.path))
    plan = spark.createDataFrame(rows, "table string, input string, bucket string, template string")
    return plan.select("table", "input", "bucket", output_path(F.col("template"), F.lit(version), F.col("bucket"), default_bucket).alias("path"))


def export_table(
    spark: SparkSession, source: str, target: str, header: list[str] | None = None, format: str = "parquet",
    rows_per_file: int = SHEET_ROWS,
) -> None:
    """Read a table (parquet or csv files), drop what a cell cannot hold and write it as CSV.

    Every task of the scan writes its own rows, at most ``rows_per_file`` to a file, so that each file
    fits a sheet. How many files there are follows from how the table is stored.
    """
    table = read_parquet_dir(spark, source) if format == "parquet" else read_csv_dir(spark, source)
    df = strip_illegal(rename_header(table, header))
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("maxRecordsPerFile", rows_per_file).csv(target)


def publish_release(
    spark: SparkSession, registry: Registry, base: str, resource: str, version: str, out: str, default_bucket: str,
    at_once: int = 4, rows_per_file: int = SHEET_ROWS,
) -> DataFrame:
    """Publish every table of a release below ``out/<bucket>/``, ``at_once`` at a time; returns the plan with
    final paths."""
    plan = publication_plan(spark, registry, base, resource, check_version(version), default_bucket)
    plan = plan.withColumn("path", F.concat("path", F.lit(".csv")))

    def publish(step) -> None:
        export_table(spark, step.input, f"{out.rstrip('/')}/{step.bucket}/{step.path.lstrip('/')}", rows_per_file=rows_per_file)

    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(publish, plan.collect()))  # one row per table
    return plan


def dictionary_bucket(buckets: list[str], default_bucket: str) -> str:
    """Bucket of the dictionary: a clinical one, else a nominative one, else the default."""
    for kind in ("clinical", "nominative"):
        for bucket in buckets:
            if kind in bucket:
                return bucket
    return default_bucket


def _writer(folder: str, header: bytes):
    """Lines of a task in one compressed file below a header, each as often as its count tells. A task that runs
    again writes the same file."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base, _ = place_of(folder)
        number = TaskContext.get().partitionId()
        draft = f"{base}/.{uuid.uuid4().hex}.partial"
        press = zlib.compressobj(1, wbits=31)
        held, size, total, stream = [header], len(header), 0, None
        try:
            for batch in batches:
                for line, n in zip(*(column.to_pylist() for column in batch.columns)):
                    stream = stream or where.open_output_stream(draft)
                    held.append(f"{line}\n".encode() * n)
                    size, total = size + len(held[-1]), total + n
                    if size >= _BLOCK:
                        stream.write(press.compress(b"".join(held)))
                        held, size = [], 0
            if stream:
                stream.write(press.compress(b"".join(held)) + press.flush())
                stream.close()
                where.move(draft, f"{base}/part-{number:06d}.csv.gz")
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["n"])
        except Exception:
            if stream:
                stream.close()
                where.delete_file(draft)
            raise

    return write


def _reached(folder: str) -> bool:
    try:
        return bool(place_of(folder))
    except Exception:
        return False


def _write_copies(flat: DataFrame, times: str, target: str) -> None:
    """Every row as often as ``times`` tells, as Spark's CSV writer would put it: a row is made text once, and its
    copies are made and compressed as bytes, where the file is written."""
    spark, names = flat.sparkSession, [c for c in flat.columns if c != times]
    store = Store(spark)
    target = store.qualified(target).rstrip("/")
    line = F.coalesce(F.to_csv(F.struct(*names), _CSV), F.lit(""))
    lines = durable(flat.where(F.col(times) > 0).select(line.alias("line"), F.col(times).cast("bigint").alias("n")))
    copies, text = lines.agg(F.sum("n"), F.sum(F.col("n") * (F.octet_length("line") + 1))).first()
    if not copies or not _reached(target):
        rows = _repeat(flat.withColumnRenamed(times, TIMES), names)
        rows.write.mode("overwrite").options(header=True, compression="gzip", **_CSV).csv(target)
        return
    small_batches(spark)
    header = spark.range(1).select(F.to_csv(F.struct(*[F.lit(c).alias(c) for c in names]), _CSV)).first()[0]
    staged = f"{target}__staged-{uuid.uuid4().hex[:8]}"
    store.make_dirs(staged)
    try:
        dealt = in_shares(lines, "n", -(-text // _TASK))
        written = dealt.mapInArrow(_writer(staged, f"{header}\n".encode()), "n bigint").agg(F.sum("n")).first()[0]
        if written != copies:
            raise RuntimeError(f"{written} of {copies} rows were written to {target}")
        store.write_text(f"{staged}/_SUCCESS", "")
    except Exception:
        store.delete(staged)
        raise
    store.swap(target, staged)
    forget(lines)


def _texts(stream) -> Iterator[bytes]:
    """The text of a compressed file, some of it at a time."""
    inflate, held, size = zlib.decompressobj(wbits=31), [], 0
    while data := stream.read(1 << 16):
        for i in range(0, len(data), _INFLATE):
            more = data[i:i + _INFLATE]
            while more:
                if inflate.eof:
                    inflate = zlib.decompressobj(wbits=31)
                held.append(inflate.decompress(more, _BLOCK))
                more, size = inflate.unconsumed_tail or inflate.unused_data, size + len(held[-1])
                if size >= _BLOCK:
                    yield b"".join(held)
                    held, size = [], 0
    while rest := inflate.decompress(b"", _BLOCK):
        held.append(rest)
    yield b"".join(held)


def runs_of_lines(texts: Iterator[bytes]) -> Iterator[tuple[bytes, int]]:
    """Lines, and how often each follows itself; copies are compared many at once. Lines end as Spark ends them."""
    rest, last, count, span = b"", None, 0, 256
    for text in texts:
        buf = rest + text
        if b"\r" in buf:  # one at the end may be half of an end
            held = buf.endswith(b"\r")
            buf = buf[:len(buf) - held].replace(b"\r\n", b"\n").replace(b"\r", b"\n") + b"\r" * held
        end = buf.rfind(b"\n") + 1
        at, rest, values = 0, buf[end:], np.frombuffer(buf, np.uint8, end)
        while at < end:
            line = buf[at:buf.index(b"\n", at) + 1]
            size = len(line)
            n = 1
            if buf.startswith(line, at + size):
                # As long as copies follow, every byte is the one that lies a line before it.
                alike = size
                while True:
                    differ = values[at + alike:at + alike + span] != values[at + alike - size:at + alike - size + span][:end - at - alike]
                    first = int(differ.argmax()) if differ.size else 0
                    if differ.size and differ[first]:
                        alike += first
                        break
                    alike += differ.size
                    if at + alike >= end:
                        break
                    span = min(2 * span, _BLOCK)
                n, span = alike // size, max(256, min(2 * alike, _BLOCK))
            at += n * size
            if line == last:
                count += n
            else:
                if count:
                    yield last[:-1], count
                last, count = line, n
    if count:
        yield last[:-1], count
    for line in rest.removesuffix(b"\r").split(b"\r"):
        if line:
            yield line, 1


def read_folded(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of a published sheet as ``spark.read.csv`` gives them, each with the number of its copies that
    follow each other in a file in ``TIMES``; a row may come several times."""
    store = Store(spark)
    folder = store.qualified(folder).rstrip("/")
    names = [e.name for e in store.children(folder) if e.name[0] not in "._"]
    columns = spark.read.options(header=True, **_CSV).csv(folder).columns
    blank = bytes(range(33))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base, _ = place_of(folder)

        def rows(found):
            lines, counts = zip(*found)
            return pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], ["line", TIMES])

        for batch in batches:
            for i in batch.column(0).to_pylist():
                with where.open_input_file(f"{base}/{names[i]}") as stream:
                    below, found = False, []
                    for line, n in runs_of_lines(_texts(stream)):
                        if not line.strip(blank):
                            continue
                        if not below:  # the header comes once in each file
                            below, n = True, n - 1
                        if n:
                            found.append((line, n))
                        if len(found) == _ROWS:
                            yield rows(found)
                            found = []
                    if found:
                        yield rows(found)

    lines = durable(spark.range(0, len(names), 1, max(1, len(names))).mapInArrow(fetch, f"line string, {TIMES} bigint"))
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    return lines.select(F.from_csv("line", schema, _CSV).alias("row"), TIMES).select("row.*", TIMES)


def publish_dictionary(
    sheets: dict[str, DataFrame], out: str, resource: str, version: str, buckets: list[str], default_bucket: str,
    times: str | None = None,
) -> str:
    """Write the result sets as one set of CSV folders; returns the folder that holds them.

    The files are compressed: a row that comes once per variable costs next to nothing after the first time.
    Sheets that have the column ``times`` come folded: their rows are written as often as it tells, without it.
    """
    name = f"{resource}_dictionary_{version.replace('-', '_')}"
    folder = f"{out.rstrip('/')}/{dictionary_bucket(buckets, default_bucket)}/{version}/{name}"
    for sheet, df in sheets.items():
        flat = df.select([
            F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in df.dtypes
        ])
        target = f"{folder}/{re.sub(' ', '_', sheet.lower())}"
        if times in df.columns:
            _write_copies(flat, times, target)
        else:
            flat.write.mode("overwrite").options(header=True, compression="gzip", **_CSV).csv(target)
    return folder
