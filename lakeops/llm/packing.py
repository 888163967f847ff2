"""Packing by concatenating and cutting.

All documents form one stream of ids; sequence k is ids k * size up to (k + 1) * size of it. The place
of a document in the stream needs no sort and no pass over the ids: the first pass encodes each
partition and notes where each document starts in it, the second adds up one total per partition and
shifts. Only the last sequence of the whole stream is short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeops.llm.chunks import encode_texts, with_end
from lakeops.llm.shared import written
from lakeops.llm.words import bounded_batches


def _encoder(path: str, end_id: int, keeps_white: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, counts = with_end(*encode_texts(batch.column(1), path, keeps_white), end_id)
            ends = np.cumsum(counts)
            cells = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(counts),
                [None, pa.py_buffer(np.concatenate([np.zeros(1, np.int64), ends * 4])), pa.py_buffer(ids.astype("<u4"))],
            ).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(counts), part, np.int32)), pa.array(start + ends - counts),
                 pa.array(counts), cells],
                ["doc_id", "part", "part_start", "doc_tokens", "ids"],
            )
            start += int(ends[-1]) if len(ends) else 0

    return encode


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 4096, keeps_white: bool = False,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Pieces of documents, laid out in sequences of ``size`` ids.

    ``doc_id, start, length`` say which ids of which document a piece holds (``start``: ids of the
    document before it), ``sequence_id, offset`` where they lie, ``ids`` are the ids as little-endian
    unsigned 32-bit integers and ``doc_tokens`` the length of the whole document with its end id. A
    piece is the boundary record of its sequence: the one at offset 0 with ``start`` > 0 continues
    the sequence before.

    A null or empty text is its end id alone. Keys are carried as they are: rows that repeat a key,
    or have none, are packed each by itself. Other columns do not matter.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    encoded = written(
        docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
            _encoder(tokenizer, end_id, keeps_white),
            f"doc_id {kind}, part int, part_start long, doc_tokens long, ids binary"),
        "encoded")
    # One row per partition of the first pass, whatever their number of documents.
    totals = encoded.groupBy("part").agg(F.sum("doc_tokens").alias("tokens"))
    places = written(totals.select(
        "part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("base")), "places")
    begin = F.col("base") + F.col("part_start")
    placed = encoded.join(places, "part").select("doc_id", "doc_tokens", "ids", begin.alias("begin"))
    cut = placed.select("*", F.explode(F.sequence(
        F.floor(F.col("begin") / size), F.floor((F.col("begin") + F.col("doc_tokens") - 1) / size))).alias("sequence_id"))
    low = F.greatest(F.col("begin"), F.col("sequence_id") * size)
    high = F.least(F.col("begin") + F.col("doc_tokens"), (F.col("sequence_id") + 1) * size)
    cut = cut.select("doc_id", (low - F.col("begin")).alias("start"), (high - low).alias("length"), "doc_tokens",
                     "sequence_id", (low - F.col("sequence_id") * size).alias("offset"), "ids")
    return cut.withColumn("ids", F.expr("substring(ids, CAST(4 * start + 1 AS INT), CAST(4 * length AS INT))"))


def sequences(pieces: DataFrame, size: int = 4096, pad_id: int = 0) -> DataFrame:
    """Whole sequences from ``pack``: ``ids`` padded to ``size`` (a short sequence whose length is a
    power of two stays as it is), ``n_tokens`` without padding, and ``boundaries``, the offset and
    document of each piece. A group is one sequence, so it holds at most ``size`` pieces."""
    found = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"]))
    n = F.col("n_tokens")
    missing = F.when(n.bitwiseAND(n - 1) == 0, F.lit(0)).otherwise(F.lit(size) - n).cast("int")
    pad = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), missing))
    return found.select(
        "sequence_id", "n_tokens", F.concat(joined, pad).alias("ids"), missing.alias("padding"),
        F.transform("p", lambda p: F.struct(p["offset"].alias("offset"), p["doc_id"].alias("doc_id"),
                                            p["start"].alias("start"), p["length"].alias("length"))).alias("boundaries"))
