"""Exact comparison of the members of groups that may be of any size.

A group is cut into blocks. A block is linked within itself first, then the heads of a group's connected
parts with each other. In groups that still are not one, the largest part is left alone and only what is not
in it is compared with all. So a crowd of near copies costs about as many comparisons as it has members, and
copies of its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.llm.components import components
from lakeops.llm.shared import written
from lakeops.llm.sketches import mixed
from lakeops.operators.skew import lookup_join

#: Members that are compared at once, by parity and as whole sets; bytes of such sets.
PARITY_BLOCK, SET_BLOCK, BLOCK_BYTES = 4096, 512, 16 << 20
WORDS = 8
_VALUE = np.uint64(0xE7037ED1A0B428DB)


def set_print(hashes: np.ndarray) -> int:
    """Signed 64-bit name of a set; 0 for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64)) if len(hashes) else 0


def unite(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the groups of i and j; labels point to the smallest member."""
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(labels[labels], labels):
            labels[:] = labels[labels]


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """A row of words per set; each element flips one of its bits."""
    out = np.zeros((len(sets), WORDS), np.uint64)
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    every = mixed(np.concatenate(sets) + _VALUE) if len(sets) else np.zeros(0, np.uint64)
    row, bit = np.repeat(np.arange(len(sets)), lengths), (every >> np.uint64(55)).astype(np.int64)
    np.bitwise_xor.at(out, (row, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out


def _may_differ(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Elements that sets of these sizes may differ in; -1 if their sizes alone tell them apart."""
    return np.where(100 * np.minimum(a, b) >= percent * np.maximum(a, b), (a + b) * (100 - percent) // (100 + percent), -1)


def _apart(parity: np.ndarray, others: np.ndarray) -> np.ndarray:
    out = np.zeros((len(parity), len(others)), np.int64)
    for w in range(WORDS):
        out += np.bitwise_count(parity[:, w, None] ^ others[None, :, w])
    return out


def by_parity(sizes: np.ndarray, payload: list[bytes], label: np.ndarray, side: np.ndarray, percent: int) -> np.ndarray:
    """Labels of members after all pairs that sizes and parities let pass are united; ``side`` -1 meets all sides,
    others only other sides."""
    parity = np.frombuffer(b"".join(payload), np.uint64).reshape(len(payload), WORDS)
    labels = np.unique(label, return_inverse=True)[1]
    first = np.full(int(labels.max()) + 1, len(labels))
    np.minimum.at(first, labels, np.arange(len(labels)))
    labels = first[labels]
    for at in range(0, len(sizes), 256):
        part = slice(at, at + 256)
        near = _apart(parity[part], parity) <= _may_differ(sizes[part, None], sizes[None, :], percent)
        near &= (side[part, None] < 0) | (side[part, None] != side[None, :])
        i, j = np.nonzero(near)
        unite(labels, i + at, j)
    return labels


def by_sets(sizes: np.ndarray, payload: list[bytes], label: np.ndarray, side: np.ndarray, percent: int) -> np.ndarray:
    """The same with the sets themselves, starting with the first member against all, so that members it links need no
    more comparisons with each other."""
    sets = [np.frombuffer(x, np.uint64) for x in payload]
    parity = parities(sets)
    labels = np.unique(label, return_inverse=True)[1]
    first = np.full(int(labels.max()) + 1, len(labels))
    np.minimum.at(first, labels, np.arange(len(labels)))
    labels = first[labels]
    for i in range(len(sets) - 1):
        near = (labels[i + 1:] != labels[i]) & ((side[i] < 0) | (side[i + 1:] != side[i]))
        near &= _apart(parity[i:i + 1], parity[i + 1:])[0] <= _may_differ(sizes[i], sizes[i + 1:], percent)
        for j in (np.flatnonzero(near) + i + 1).tolist():
            if labels[i] != labels[j]:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    low, high = sorted((labels[i], labels[j]))
                    labels[labels == high] = low
    return labels


def compared(compare: Callable, percent: int) -> Callable[[DataFrame], DataFrame]:
    """Links ``a, b`` among rows ``root, low, high, side, node, label, n, payload`` that agree in the first three,
    one per member; within a block (low = high) all sides meet, else only different ones."""
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def found():
            ids, label, sizes = (np.array([h[k] for h in held], np.int64) for k in (1, 2, 3))
            side = np.array([h[0] if at[1] != at[2] else -1 for h in held], np.int64)
            labels = compare(sizes, [h[4] for h in held], label, side, percent)
            moved = labels != np.arange(len(labels))
            return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[labels[moved]])], ["a", "b"])

        for batch in batches:
            for root, low, high, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (root, low, high):
                    if len(held) > 1:
                        yield found()
                    held, at = [], (root, low, high)
                held.append(row)
        if len(held) > 1:
            yield found()

    def linked(rows: DataFrame) -> DataFrame:
        columns = ["root", "low", "high", "side", "node", "label", "n", "payload"]
        return rows.select(*columns).repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "node").mapInArrow(links, "a long, b long")

    return linked


def grouped(reached: DataFrame, node: str = "fp") -> DataFrame:
    """``node, root`` of all members of the components in ``reached``, roots included."""
    return reached.select(F.col("node").alias(node), "root").unionByName(reached.select(F.col("root").alias(node), "root").distinct())


def crowd_links(members: DataFrame, linked: Callable[[DataFrame], DataFrame], block: int) -> DataFrame:
    """``a, b``: links that connect the members ``root, node, ...`` of each root as those of all pairs do.

    ``linked`` gives links among rows with the same ``root, low, high``, as ``compared`` does. A block has at most
    about ``block`` members, and bytes of ``payload`` if there is one. A node may be a member of several roots.
    ``members`` is read several times, so it should be a table."""
    full = F.ceil(F.count("*") / block)
    if "payload" in members.columns:
        full = F.greatest(full, F.ceil(F.sum(F.length("payload")) / BLOCK_BYTES))

    def sided(rows: DataFrame, crowded: DataFrame) -> DataFrame:
        return lookup_join(rows, crowded, ["root"]).withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    def crowded_of(rows: DataFrame) -> DataFrame:
        return written(rows.groupBy("root").agg(full.cast("int").alias("blocks")).where("blocks > 1"), "crowded")

    def within(rows: DataFrame) -> DataFrame:
        return linked(rows.withColumn("low", F.col("side")).withColumn("high", F.col("side")))

    def all_pairs(rows: DataFrame) -> DataFrame:
        """Every pair of blocks of a root is a group of its own, and each block with itself."""
        crowded = crowded_of(rows)
        plain = within(lookup_join(rows, crowded, ["root"], "left_anti").withColumn("side", F.lit(0)))
        if crowded.isEmpty():
            return plain
        other = sided(rows, crowded).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return plain.unionByName(linked(other.withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other"))))

    crowded = crowded_of(members)
    members = members.withColumn("label", F.col("node"))
    if crowded.isEmpty():
        return within(members.withColumn("side", F.lit(0)))
    plain = within(lookup_join(members, crowded, ["root"], "left_anti").withColumn("side", F.lit(0)))
    crowd = written(sided(members, crowded).drop("blocks"), "crowd")
    links = written(within(crowd), "links")

    def labelled(links: DataFrame) -> DataFrame:
        reached = components(links).select("node", F.col("root").alias("own"))
        rows = lookup_join(crowd.drop("side"), reached, ["node"], "left")
        return written(rows.withColumn("label", F.coalesce("own", "label")).drop("own"), "crowd")

    rows = labelled(links)
    rest = [c for c in rows.columns if c not in ("root", "label")]
    heads = written(rows.groupBy("root", "label").agg(F.min(F.struct("node", *[c for c in rest if c != "node"])).alias("x")).select("root", "label", "x.*"), "heads")
    links = written(links.unionByName(all_pairs(heads)), "links")
    rows = labelled(links)
    parts = written(rows.groupBy("root", "label").agg(F.count("*").alias("n_part")), "parts")
    largest = parts.groupBy("root").agg(F.count("*").alias("n_parts"), F.max(F.struct("n_part", "label")).alias("x")).where("n_parts > 1")
    still = written(largest.select("root", F.col("x.label").alias("largest")), "open")
    links = plain.unionByName(links)
    if still.isEmpty():
        return links
    # What is not in the largest part, in blocks of its own, meets all blocks of its root.
    rows = written(lookup_join(rows, still, ["root"]), "open_rows")
    outside = rows.where("label <> largest")
    blocks = crowded.withColumnRenamed("blocks", "n_all").join(outside.groupBy("root").agg(full.cast("int").alias("n_out")), "root")
    rows, outside = (lookup_join(r.drop("largest"), blocks, ["root"]) for r in (rows, outside))
    all_of = F.pmod(F.xxhash64("node"), F.col("n_all")).cast("int")
    out_of = -1 - F.pmod(F.xxhash64("node"), F.col("n_out")).cast("int")
    met = outside.withColumn("side", out_of).withColumn("low", F.col("side")).withColumn(
        "high", F.explode(F.sequence(F.lit(0), F.col("n_all") - 1)))
    meeting = rows.withColumn("side", all_of).withColumn("high", F.col("side")).withColumn(
        "low", F.explode(F.sequence(-F.col("n_out"), F.lit(-1))))
    return links.unionByName(linked(met.unionByName(meeting)))
