"""SimHash fingerprints, and near-duplicate groups found by a generalised pigeonhole index.

Fingerprints at most ``t`` bits apart agree, in at least one of several partitions of the bits, up to
that partition's own threshold, as long as the thresholds plus one add up to ``t + 1``. A threshold of
-1 leaves a partition out. Bits that vary together go into one partition, so that one stays cheap to
probe even where fingerprints crowd; thresholds are then given out by dynamic programming over the
estimated number of probes and candidates, and the number of partitions with the least total is used.
All of this steers cost only: whatever a sample says, no pair within the distance is missed.

A probe of threshold k deletes each choice of k bits of the partition, so both ends of a pair meet
under an equal key. Candidates of a key are compared in the task that holds them, never written out.
What leaves the task is at most one link per fingerprint to the smallest one it is connected to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lakeops.llm.components import components
from lakeops.llm.crowds import crowd_links, unite
from lakeops.llm.shared import few_by_hash, written
from lakeops.llm.words import bounded_batches, flat
from lakeops.operators.skew import lookup_join

BITS = 64
SEED = 42
#: Fingerprints that are looked at to plan partitions and thresholds.
PLAN_SAMPLE = 4000
#: Members of one key that are compared at once; larger groups are cut into blocks (``crowds``).
BLOCK = 1024
#: Cost of shuffling one key, in candidate comparisons.
KEY_COST = 300.0


def fingerprint_batch(texts: pa.Array, size: int = 4) -> np.ndarray:
    """Unsigned 64-bit fingerprints: bit i is set if it is set in over half of the shingles' XXH64."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(flat(texts)):
        words = text.as_buffer().to_pybytes().lower().split()  # both know ASCII only, as asked
        n = len(words)
        if not n:
            continue
        joined = b" ".join(words)
        if n <= size:
            hashes = [digest(joined, SEED)]
        else:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
            starts = np.concatenate([np.zeros(1, np.int64), ends[: n - size]])
            hashes = [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[size - 1:] - 1).tolist())]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = bits.sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
    return out


@F.arrow_udf(LongType())
def _fingerprint(texts: pa.Array) -> pa.Array:
    return pa.array(fingerprint_batch(texts).view(np.int64))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp``: the key and the fingerprint (as a signed long) of every row; no shuffle."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(key).alias("doc_id"), _fingerprint(F.col(text)).alias("fp"))


# --- plan ---------------------------------------------------------------------------------------------


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Cut the 64 bits into groups of nearly equal size, correlated bits together."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    bits -= bits.mean(axis=0) if len(bits) else 0
    scale = np.sqrt((bits**2).sum(axis=0))
    scale[scale == 0] = 1
    tied = np.abs((bits / scale).T @ (bits / scale))
    np.fill_diagonal(tied, 0)
    left, groups = list(range(BITS)), []
    for p in range(parts):
        size = BITS // parts + (p < BITS % parts)
        group = [max(left, key=lambda b: (tied[b, left].max(), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (tied[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def allocate(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds with the least total cost whose values plus one add up to ``distance + 1``.

    ``costs[i][k]``: cost of threshold ``k - 1`` in partition i, so ``k = 0`` leaves it out.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for k, more in enumerate(row):
                if used + k <= distance + 1 and (used + k not in step or cost + more < step[used + k][0]):
                    step[used + k] = (cost + more, [*chosen, k - 1])
        best = step
    return best[distance + 1]


def plan(sample: np.ndarray, count: int, distance: int) -> list[tuple[list[int], int]]:
    """Partitions (their bits) and thresholds for ``count`` fingerprints, estimated from a sample."""
    options = []
    xor = sample[:, None] ^ sample[None, :] if len(sample) <= 2000 else sample[:2000, None] ^ sample[None, -2000:]
    for parts in range(2, distance + 3):
        groups = group_bits(sample, parts)
        costs = []
        for group in groups:
            apart = np.bitwise_count(xor & np.uint64(sum(1 << b for b in group)))
            row, width = [0.0], len(group)
            for k in range(distance + 1):
                seen = (apart <= k).sum() - (len(sample) if len(sample) <= 2000 else 0)
                share = max(seen / max(1, apart.size), sum(comb(width, j) for j in range(k + 1)) / 2.0**width)
                row.append(count * comb(width, k) * KEY_COST + count * (count / 2) * share * comb(width, k) / max(1, k + 1))
            costs.append(row)
        total, chosen = allocate(costs, distance)
        options.append((total, parts, [(g, k) for g, k in zip(groups, chosen) if k >= 0]))
    return min(options, key=lambda o: o[:2])[2]


def keys_of(prints: np.ndarray, partitions: list[tuple[list[int], int]]) -> Iterator[np.ndarray]:
    """For each partition and choice of deleted bits, the keys of all fingerprints."""
    for p, (group, threshold) in enumerate(partitions):
        value = np.zeros(len(prints), np.uint64)
        for place, bit in enumerate(group):
            value |= ((prints >> np.uint64(bit)) & np.uint64(1)) << np.uint64(place)
        for v, gone in enumerate(combinations(range(len(group)), threshold)):
            mask = np.uint64(sum(1 << place for place in range(len(group)) if place not in gone))
            yield ((value & mask) | np.uint64(p << 56 | v << 36)).view(np.int64)


# --- probe and verify ---------------------------------------------------------------------------------


def _large_run(prints: np.ndarray, side: np.ndarray, cross: bool, distance: int) -> np.ndarray:
    labels = np.arange(len(prints))
    for at in range(0, len(prints), 256):
        near = np.bitwise_count(prints[at: at + 256, None] ^ prints[None, :]) <= distance
        if cross:
            near &= side[at: at + 256, None] != side[None, :]
        i, j = np.nonzero(near)
        unite(labels, i + at, j)
    return labels


def run_links(runs: np.ndarray, cross: np.ndarray, side: np.ndarray, ids: np.ndarray, prints: np.ndarray, distance: int):
    """Links among the members of each run of equal keys, as (id, smallest id it is connected to)."""
    nodes, place = np.unique(ids, return_inverse=True)
    labels = np.arange(len(nodes))
    starts = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(runs)]]))
    for s, n in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist()):
        own = _large_run(prints[s: s + n], side[s: s + n], bool(cross[s]), distance)
        unite(labels, place[s: s + n], place[s + own])
    at, left = starts[sizes <= 64], sizes[sizes <= 64]
    member = np.repeat(at, left) + np.arange(int(left.sum())) - np.repeat(np.cumsum(left) - left, left)
    after = np.repeat(at + left, left) - member  # members from here to the end of the run
    for step in range(1, 64):
        member, after = member[after > step], after[after > step]
        if not len(member):
            break
        near = np.bitwise_count(prints[member] ^ prints[member + step]) <= distance
        near &= ~cross[member] | (side[member] != side[member + step])
        unite(labels, place[member[near]], place[member[near] + step])
    linked = labels != np.arange(len(nodes))
    return nodes[linked], nodes[labels[linked]]


def near_links(points: DataFrame, distance: int, block: int = BLOCK) -> DataFrame:
    """``a, b`` (ids, a > b): links that connect the points ``id, fp`` exactly as all pairs of
    fingerprints at most ``distance`` bits apart do. ``points`` has distinct ids and fingerprints and
    is read several times, so it should be a table."""
    spark = points.sparkSession
    count = points.count()
    rows = few_by_hash(points.select("fp"), "fp", PLAN_SAMPLE).collect()  # bounded, for estimates
    partitions = plan(np.array([r.fp for r in rows], np.int64).view(np.uint64), count, distance)

    def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.asarray(batch.column(1)).view(np.uint64)
            for key in keys_of(prints, partitions):
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0), batch.column(1)], ["bucket", "id", "fp"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def found(part: pa.Table):
            bucket, low, high, side, ids, prints = (np.asarray(c) for c in part.columns)
            change = np.concatenate([[0], ((bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))])
            a, b = run_links(np.cumsum(change), low != high, side, ids, prints.view(np.uint64), distance)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            last = [held.column(c)[-1].as_py() for c in range(3)]
            same = np.logical_and.reduce([np.asarray(held.column(c)) == last[c] for c in range(3)])
            cut = int(np.argmax(same))
            if cut:
                yield found(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield found(held)

    def linked(rows: DataFrame) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
        columns = [F.col("root").alias("bucket"), "low", "high", "side", F.col("node").alias("id"), "fp"]
        return rows.select(*columns).repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "side").mapInArrow(links, "a long, b long")

    keyed = written(points.select("id", "fp").mapInArrow(key_rows, "bucket long, id long, fp long"), "keys")
    return crowd_links(keyed.select(F.col("bucket").alias("root"), F.col("id").alias("node"), "fp"), linked, block)


def near_duplicates(docs: DataFrame, distance: int = 4, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """``doc_id, fp, component_id`` for every row: its fingerprint and the smallest key that can be
    reached over links of at most ``distance`` bits, itself included.

    Texts without words (null, empty, blank) have fingerprint 0 and link like any other. Rows that
    repeat a key each count. A row without a key gets the component of the rows with its fingerprint;
    null if none of them has a key. Equal fingerprints are folded into one point first, so groups of
    copies cost one point each; other columns do not matter.
    """
    prints = written(fingerprints(docs, key, text), "fingerprints")
    points = written(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("id")), "points")
    reached = components(near_links(points, distance, block))
    named = points.join(reached, F.col("id") == F.col("node"), "left").select(
        F.col("fp"), F.coalesce("root", "id").alias("component_id"))
    return lookup_join(prints, named, ["fp"], "left").select("doc_id", "fp", "component_id")


def first_rows(docs: DataFrame, groups: DataFrame, print_of: Callable, key: str, text: str) -> DataFrame:
    """The rows of ``docs`` with one row per component of ``groups`` (``doc_id, fp, component_id`` of every
    row with a key): the one with the smallest key, then fingerprint. All columns unchanged.

    Of rows that share that key and its fingerprint, one stays; ``print_of`` a text gives the fingerprint.
    Rows without a key cannot be named by a group and all stay.
    """
    found = written(groups.groupBy("component_id", "doc_id", "fp").agg(F.count("*").alias("n")), "groups")
    names = set(docs.columns)
    mark, own = (next(m for m in (f"__{n}{i}" for i in range(len(names) + 1)) if m not in names) for n in ("kept", "print"))
    repeated = written(found.groupBy("doc_id").agg(F.sum("n").alias("n")).where("n > 1").select(F.col("doc_id").alias(mark)), "repeated")
    least = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "fp")).alias("x"))
    firsts = written(least.select(F.col("x.doc_id").alias(mark), F.col("x.fp").alias(f"{mark}_fp")), "firsts")
    # The keys grow with the documents, so they are never broadcast.
    single = firsts.join(repeated, mark, "left_anti").select(mark).hint("shuffle_hash")
    kept = docs.join(single, docs[key] == F.col(mark), "left_semi").unionByName(docs.where(F.col(key).isNull()))
    if repeated.isEmpty():
        return kept
    # Only rows that share a key need their fingerprint again to tell them apart.
    shared = written(docs.join(repeated, docs[key] == F.col(mark), "left_semi"), "shared").withColumn(own, print_of(F.col(text)))
    shared = shared.join(firsts, (F.col(key) == F.col(mark)) & (F.col(own) == F.col(f"{mark}_fp")), "left_semi")
    return kept.unionByName(shared.dropDuplicates([key, own]).drop(own))


def one_of_each(docs: DataFrame, distance: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row per group, as ``first_rows`` chooses it. Fingerprints are the nodes,
    so a key that repeats with different texts ties no groups together."""
    prints = written(fingerprints(docs.where(F.col(key).isNotNull()), key, text), "fingerprints")
    points = written(prints.select(F.col("fp").alias("id"), "fp").distinct(), "points")
    reached = components(near_links(points, distance))
    groups = lookup_join(prints, reached.withColumnRenamed("node", "fp"), ["fp"], "left").select("doc_id", "fp", F.coalesce("root", "fp").alias("component_id"))
    return first_rows(docs, groups, _fingerprint, key, text)
