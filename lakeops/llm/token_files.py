"""Token ids as binary files: one concatenated id array, document boundaries in Elias-Fano code.

A file is one segment: a head of eight big-endian 64-bit numbers (magic, part, place in the part,
documents, documents without a key, ids, bytes of the keys, bytes of the boundaries), the document
keys and the boundaries as Elias-Fano lists, the ids as little-endian unsigned integers of two bytes
(four for vocabularies over 65,536), and one line feed that Spark's text writer adds. Boundary i is
the number of ids of the segment before its document i, so ``select`` answers "where does document i
start" without a table of 64-bit offsets.

Files are written by Spark's own writer and committed with the job: a lost executor or a second
attempt of a task leaves no stray file, and any file system that Spark can write to will do. Keys
ascend within a file, from file to file and from part to part; ``manifest`` holds, per file, the ids
and documents before it, added up from one total per part.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeops.llm.chunks import coder, encode_texts, with_end
from lakeops.llm.elias_fano import EliasFano
from lakeops.llm.words import bounded_batches

MAGIC = int.from_bytes(b"EFTOKEN1", "big")
_HEAD = ">8Q"


class Segment(NamedTuple):
    part: int
    place: int
    keys: list[int | None]
    bounds: EliasFano
    ids: np.ndarray

    def document(self, i: int) -> np.ndarray:
        """Ids of document i, found with two selects."""
        return self.ids[self.bounds.select(i): self.bounds.select(i + 1)]


def dump_segment(part: int, place: int, keys: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    keyless = sum(k is None for k in keys)
    named = EliasFano.of(np.array(keys[keyless:], np.int64)).dump()
    bounds = EliasFano.of(np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])).dump()
    head = struct.pack(_HEAD, MAGIC, part, place, len(keys), keyless, len(ids), len(named), len(bounds))
    return head + named + bounds + ids.tobytes()


def load_segment(data: bytes) -> Segment:
    magic, part, place, n, keyless, n_ids, n_named, n_bounds = struct.unpack_from(_HEAD, data)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = struct.calcsize(_HEAD)
    named, _ = EliasFano.load(data, at)
    bounds, _ = EliasFano.load(data, at + n_named)
    at += n_named + n_bounds
    width = (len(data) - at) // max(1, n_ids)  # the line feed is less than one id
    ids = np.frombuffer(data, "<u2" if width == 2 else "<u4", n_ids, at) if n_ids else np.zeros(0, "<u2")
    return Segment(part, place, [None] * keyless + named.all().tolist(), bounds, ids)


def _writer(tokenizer: str, end_id: int, keeps_white: bool, segment_ids: int):
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        dtype = coder(tokenizer).dtype if end_id < 1 << 16 else np.dtype("<u4")
        keys: list[int | None] = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush():
            nonlocal keys, counts, ids, held, place
            blob = dump_segment(part, place, keys, np.concatenate(counts), np.concatenate(ids))
            keys, counts, ids, held, place = [], [], [], 0, place + 1
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["blob"])

        for batch in batches:
            if not batch.num_rows:
                continue
            got, n = with_end(*encode_texts(batch.column(1), tokenizer, keeps_white), end_id)
            keys += batch.column(0).to_pylist()
            counts.append(n)
            ids.append(got.astype(dtype))
            held += len(got)
            if held >= segment_ids:
                yield flush()
        if keys:
            yield flush()

    return segments


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, keeps_white: bool = True, segment_ids: int = 1 << 19,
    key: str = "doc_id", text: str = "text",
) -> None:
    """Encode all documents into token files below ``path``, in ascending key order.

    A segment closes with the batch that takes it to ``segment_ids`` ids or more. A null or empty
    text is its end id alone. Rows without a key come first, rows that share a key in the order of
    their texts. Other columns do not matter. An empty table gives no file.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    blobs = ordered.mapInArrow(_writer(tokenizer, end_id, keeps_white, segment_ids), "blob binary")
    # The text writer copies the bytes of a value to the file as they are.
    blobs.select(F.col("blob").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(f"{path}/segments")

    number = lambda i: F.conv(F.hex(F.substring("content", 8 * i + 1, 8)), 16, 10).cast("long")
    heads = _files(spark, path).select(
        number(1).alias("part"), number(2).alias("place"), number(3).alias("docs"), number(5).alias("ids"))
    totals = heads.groupBy("part").agg(F.sum("docs").alias("docs"), F.sum("ids").alias("ids"))
    before = Window.orderBy("part")
    bases = totals.select("part", (F.sum("docs").over(before) - F.col("docs")).alias("base_docs"),
                          (F.sum("ids").over(before) - F.col("ids")).alias("base_ids"))
    inside = Window.partitionBy("part").orderBy("place")
    heads.select(
        "part", "place", (F.sum("docs").over(inside) - F.col("docs")).alias("d"), (F.sum("ids").over(inside) - F.col("ids")).alias("i"),
    ).join(bases, "part").select(
        "part", "place", (F.col("base_docs") + F.col("d")).alias("first_doc"), (F.col("base_ids") + F.col("i")).alias("first_id"),
    ).coalesce(1).write.parquet(f"{path}/manifest")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{path}/segments").select("content")


def _reader(with_ids: bool):
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                s = load_segment(data.as_buffer())
                edges = s.bounds.all()
                cells = [s.ids[a:b].astype("<u4").tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                n = len(s.keys)
                columns = {
                    "part": pa.array(np.full(n, s.part)), "place": pa.array(np.full(n, s.place)), "i": pa.array(np.arange(n)),
                    "doc_id": pa.array(s.keys, pa.int64()), "local": pa.array(edges[:-1]), "n_tokens": pa.array(np.diff(edges)),
                    "ids_crc32": pa.array([zlib.crc32(c) for c in cells], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array(cells, pa.binary())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return documents


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents from token files: ``position`` (place among all documents), ``doc_id``, ``start`` (ids
    of all documents before), ``n_tokens``, ``ids_crc32`` and, if asked for, ``ids``; ids are
    little-endian unsigned 32-bit integers there and in the checksum."""
    schema = "part long, place long, i long, doc_id long, local long, n_tokens long, ids_crc32 long"
    bounded_batches(spark)
    docs = _files(spark, path).mapInArrow(_reader(with_ids), f"{schema}, ids binary" if with_ids else schema)
    found = docs.join(spark.read.parquet(f"{path}/manifest"), ["part", "place"])
    return found.select(
        (F.col("first_doc") + F.col("i")).alias("position"), "doc_id", (F.col("first_id") + F.col("local")).alias("start"),
        "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
