"""Bottom-k sketches of word shingles.

A sketch is the k smallest of the 64-bit hashes of a text's distinct shingles, in order. Sketches of
parts merge into the sketch of the whole, and two of them estimate resemblance, containment and the
number of distinct shingles; with fewer than k shingles all of that is exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from lakeops.llm.words import Words, bounded_batches, flat, split_words

SIZE = 5
K = 128


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: Words, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text, repeats included, and their bounds. A text with fewer words
    than ``size`` has one shingle, all its words; a text without words has none."""
    digest = xxhash.xxh64_intdigest
    own = np.fromiter((digest(w.lower()) for w in words.distinct.cast(pa.large_binary()).to_numpy(zero_copy_only=False)), np.uint64, len(words.distinct))
    step, n = np.uint64(0x9E3779B97F4A7C15), np.diff(words.bounds)
    per_text = np.where(n == 0, 0, np.maximum(1, n - size + 1))
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(per_text)])
    first = np.repeat(words.bounds[:-1] - bounds[:-1], per_text) + np.arange(bounds[-1])
    ends = np.repeat(words.bounds[1:], per_text)
    hashes = np.zeros(len(first), np.uint64)
    at = own[words.codes]
    for k in range(size):
        inside = first + k < ends
        hashes[inside] = (hashes[inside] ^ at[first[inside] + k]) * step
        hashes[inside] ^= hashes[inside] >> np.uint64(29)
    return mixed(hashes), bounds


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    return np.unique(hashes)[:k]


def sketch_batch(texts: pa.Array, k: int = K, size: int = SIZE) -> list[np.ndarray]:
    hashes, bounds = shingle_hashes(split_words(texts), size)
    return [bottom(hashes[a:b], k) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def merge(sketches: list[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of all parts together."""
    return bottom(np.concatenate(sketches), k) if sketches else np.zeros(0, np.uint64)


def distinct(sketch: np.ndarray, k: int = K) -> float:
    """Number of distinct shingles: exact below k, else from the largest hash kept."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) / ((float(sketch[-1]) + 1) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the shingles of either text that both have. Two texts without shingles are equal."""
    union = merge([a, b], k)
    if not len(union):
        return 1.0
    # A full sketch knows nothing beyond its last hash.
    known = min([int(s[-1]) for s in (a, b) if len(s) == k], default=(1 << 64) - 1)
    union = union[union <= np.uint64(known)]
    both = np.intersect1d(np.intersect1d(union, a, assume_unique=True), b, assume_unique=True)
    return len(both) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the shingles of a that b has too."""
    na, nb, r = distinct(a, k), distinct(b, k), resemblance(a, b, k)
    return 1.0 if not na else min(1.0, r * (na + nb) / (1 + r) / na)


def to_string(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def of_string(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8").astype(np.uint64)


def sketches(docs: DataFrame, text: str = "text", out: str = "sketch", k: int = K, size: int = SIZE) -> DataFrame:
    """``docs`` with the sketch of its texts (little-endian hashes) as ``out``. A null text has the empty
    sketch. No shuffle."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf(BinaryType())
    def sketch(texts: pa.Array) -> pa.Array:
        return pa.array([s.astype("<u8").tobytes() for s in sketch_batch(texts, k, size)], pa.binary())

    return docs.withColumn(out, sketch(F.col(text)))


def merged(parts: DataFrame, by: str, sketch: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per value of ``by``. Each task folds its rows first, so at most one sketch per task and
    value is shuffled, also for a value that holds most rows."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        keys = None
        for batch in batches:
            keys = batch.schema.field(0)
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(value or b"", "<u8")
                held[key] = merge([held[key], own], k) if key in held else own
            if len(held) >= 20_000:
                yield rows(held, keys)
                held = {}
        if held:
            yield rows(held, keys)

    def rows(held, keys):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), keys.type), pa.array([s.astype("<u8").tobytes() for s in held.values()], pa.binary())], [by, sketch])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, held, field, seen = None, None, None, False
        for batch in batches:
            field = batch.schema.field(0)
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(value, "<u8")
                if seen and key == open_key:
                    held = merge([held, own], k)
                    continue
                if seen:
                    yield rows({open_key: held}, field)
                open_key, held, seen = key, own, True
        if seen:
            yield rows({open_key: held}, field)

    kind = parts.schema[by].dataType.simpleString()
    schema = f"`{by}` {kind}, `{sketch}` binary"
    bounded_batches(parts.sparkSession)
    folded = parts.select(by, sketch).mapInArrow(fold, schema)
    return folded.repartition(by).sortWithinPartitions(by).mapInArrow(last, schema)


def _pairs_with_next(k: int, size: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            if held.num_rows < 2:
                continue
            texts = held.column("text").to_pylist()
            edited = []
            for this, following in zip(texts, texts[1:]):
                half = len(this) // 2
                edited.append(this[: len(this) - half] + following[:half])
            own, changed = sketch_batch(pa.array(texts, pa.large_string()), k, size), sketch_batch(pa.array(edited, pa.large_string()), k, size)
            n = len(edited)
            yield pa.RecordBatch.from_arrays(
                [held.column("doc_id").combine_chunks().slice(0, n), pa.array([len(t) for t in texts[:n]], pa.int64()),
                 pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                 pa.array([to_string(s) for s in own[:n]]), pa.array([to_string(s) for s in changed]),
                 pa.array([resemblance(a, b, k) for a, b in zip(own, changed)]),
                 pa.array([resemblance(a, b, k) for a, b in zip(own, own[1:])]),
                 pa.array([containment(a, b, k) for a, b in zip(own, changed)]),
                 pa.array([distinct(s, k) for s in own[:n]])],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
                 "contained_in_edited", "n_shingles"])
            held = held.slice(n)

    return compare


def compare_with_next(docs: DataFrame, k: int = K, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sketches of every text and of an edited one, whose second half is the start of the next text in
    ascending key order (after the last comes the first), and how alike they are.

    Rows without a key come first; rows that share a key follow each other in the order of their
    texts. A null text is the empty text. The order needs no sort of the whole table: rows go to
    ranges of keys, and each range also gets the first row of the range after it.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0] or []
    edges = np.unique(np.array(cuts, np.int64))[: parts - 1]

    @F.arrow_udf(LongType())
    def range_of(keys: pa.Array) -> pa.Array:
        lowest = pa.scalar(-(1 << 63), pa.int64())
        return pa.array(np.searchsorted(edges, np.asarray(keys.fill_null(lowest))).astype(np.int64))

    docs = docs.withColumn("range", range_of("doc_id"))
    # The first key of each range: one row per range, whatever the number of documents.
    heads = docs.groupBy("range").agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("keyless")).orderBy("range").collect()
    after = [(heads[i - 1]["range"], None if h["keyless"] else h["low"]) for i, h in enumerate(heads)]
    guards = spark.createDataFrame(after, "guarded long, head long")
    guards = docs.join(F.broadcast(guards), docs["doc_id"].eqNullSafe(guards["head"])).groupBy("guarded", "doc_id").agg(F.min("text").alias("text"))
    rows = docs.withColumn("guard", F.lit(0)).unionByName(guards.select(F.col("guarded").alias("range"), "doc_id", "text", F.lit(1).alias("guard")))
    ordered = rows.repartitionById(parts, F.col("range").cast("int")).sortWithinPartitions("range", "guard", "doc_id", "text")
    return ordered.select("doc_id", "text").mapInArrow(
        _pairs_with_next(k, size),
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
        "near_next double, contained_in_edited double, n_shingles double")
