"""Texts whose sets of word shingles have a Jaccard similarity of a bound or more, found exactly.

Sizes fall into bands so narrow that partners lie in one band or in neighbouring ones. Two sets of a band
and its next differ in at most D elements. The universe is cut into segments by a hash; a pair's
differences fall somewhere, so if segment i is given a threshold of t_i (-1: not looked at, 0: subsets must
be equal, 1: they may differ by one element) and the thresholds plus one add up to D + 1, some segment keeps
its threshold. A set is found by its subset in a segment (0), or by that and the subset less each one of its
elements (1). Number of segments and thresholds of a band are chosen for the least estimated cost of keys
and candidates, by dynamic programming over the segments. Estimates steer cost only: no allocation loses a
pair.

Sets that share a key form loose groups. Within one, pairs are first compared by size and by 512 bits of
parity, which never differ in more places than the sets do; what remains linked is compared exactly. Groups
may be of any size (``crowds``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType

from lakeops.llm.chunks import ragged
from lakeops.llm.components import components
from lakeops.llm.crowds import PARITY_BLOCK, SET_BLOCK, by_parity, by_sets, compared, crowd_links, grouped, parities, set_print
from lakeops.llm.shared import few_by_hash, written
from lakeops.llm.simhash import allocate
from lakeops.llm.sketches import mixed, shingle_hashes
from lakeops.llm.words import bounded_batches, split_words, struct_of
from lakeops.operators.skew import lookup_join

SIZE, PERCENT = 3, 90
#: Sets that are looked at to plan with, and sets of it that share a key which is then dealt to several tasks.
PLAN_SAMPLE, HOT, SALTS = 2000, 16, 64
#: Segments up to which each has a cost of its own; above, all are taken to cost the same.
OWN_COST = 64
#: Cost of a candidate pair, in keys.
PAIR_COST = 200.0
_SEEN = 500_000
_SPLIT = np.uint64(0xA0761D6478BD642F)


# --- bands and schemes -----------------------------------------------------------------------------------


def band_starts(percent: int, largest: int) -> np.ndarray:
    """Least size of each band, up to the band after that of ``largest``."""
    starts = [1]
    while len(starts) < 3 or starts[-3] <= largest:
        starts.append(starts[-1] * 100 // percent + 1)
    return np.array(starts, np.int64)


def band_of(sizes: np.ndarray, percent: int) -> np.ndarray:
    """The band of each size; -1 for empty sets."""
    return np.searchsorted(band_starts(percent, int(sizes.max(initial=0))), sizes, side="right") - 1


def most_apart(band: int, percent: int) -> int:
    """Elements that a pair may differ in whose smaller set lies in the band."""
    start = 1
    for _ in range(band + 1):
        start = start * 100 // percent + 1
    return (start - 1) * (100 - percent) // percent


class Scheme(NamedTuple):
    """Thresholds of the segments of pairs whose smaller set lies in ``band``."""

    band: int
    thresholds: tuple[int, ...]


def segment_counts(apart: int) -> list[int]:
    """Numbers of segments worth a look: from one per difference and one more, down to half of that."""
    return sorted({-(-(apart + 1) * k // 4) for k in (4, 3, 2)}, reverse=True)


def _uniform(apart: int, segments: int) -> tuple[int, ...]:
    ones = apart + 1 - segments
    return (1,) * ones + (0,) * (segments - ones)


def plan(bands: dict[int, int], mean: dict[int, float], shared: dict[tuple[int, int, int, int], float], percent: int) -> list[Scheme]:
    """Schemes for ``bands`` (number of sets by band, with ``mean`` sizes). ``shared``: by band, number of segments,
    segment (-1 for all together where they are many) and threshold, the share of pairs of a sample that meet."""
    out = []
    for band in sorted(bands):
        apart, sets = most_apart(band, percent), bands[band] + bands.get(band + 1, 0)
        if not apart or sets < 2:
            continue
        size = (bands[band] * mean[band] + bands.get(band + 1, 0) * mean.get(band + 1, 0.0)) / sets
        options = []
        for m in segment_counts(apart):
            full = size / m
            least = (np.exp(-2 * full), (np.exp(-full) * (1 + full)) ** 2)

            def cost(segment, t):
                pairs = sets * sets / 2 * max(shared.get((band, m, segment, t), 0.0), least[t])
                return sets * (1 + t * full) + PAIR_COST * pairs

            if m <= OWN_COST:
                total, thresholds = allocate([[0.0, cost(i, 0), cost(i, 1)] for i in range(m)], apart)
            else:
                thresholds = _uniform(apart, m)
                total = sum(thresholds) * cost(-1, 1) + (m - sum(thresholds)) * cost(-1, 0)
            options.append((total, m, tuple(thresholds)))
        out.append(Scheme(band, min(options)[2]))
    return out


# --- sets, parities and keys -----------------------------------------------------------------------------


def shingle_sets(texts: pa.Array, size: int = SIZE) -> list[np.ndarray]:
    """Distinct shingle hashes of each text (A to Z in lower case), in order. Fewer words than ``size`` are one
    shingle, no words none."""
    hashes, bounds = shingle_hashes(split_words(texts), size)
    return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


class Keys:
    """Keys of sets under some schemes."""

    def __init__(self, schemes: list[Scheme], bands: int):
        self.of_band = np.full(bands + 2, -1, np.int64)
        self.of_band[[s.band for s in schemes]] = np.arange(len(schemes))
        self.count = np.array([len(s.thresholds) for s in schemes], np.int64)
        self.start = np.cumsum(self.count) - self.count
        self.thresholds = np.array([t for s in schemes for t in s.thresholds], np.int64)
        self.names = np.array([s.band << 40 | len(s.thresholds) for s in schemes], np.uint64)

    def __call__(self, sets: list[np.ndarray], bands: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``owner, key, scheme, segment, threshold`` of each key. A set takes part in the scheme of its own band, and in
        that of the band before, where it may be the larger of a pair."""
        found = [self._by(sets, bands - back) for back in (0, 1)]
        return tuple(np.concatenate(c) for c in zip(*found))

    def _by(self, sets, bands):
        scheme = np.where((bands >= 0) & (bands < len(self.of_band)), self.of_band[np.clip(bands, 0, len(self.of_band) - 1)], -1)
        takes = np.flatnonzero(scheme >= 0)
        nothing = np.zeros(0, np.int64)
        if not len(takes):
            return nothing, nothing, nothing, nothing, nothing
        scheme = scheme[takes]
        lengths = np.array([len(sets[i]) for i in takes.tolist()], np.int64)
        element = np.concatenate([sets[i] for i in takes.tolist()])
        count = self.count[scheme]
        base = np.cumsum(count) - count
        own = np.repeat(np.arange(len(takes)), lengths)
        segment = (mixed(element ^ _SPLIT) >> np.uint64(32)) * count[own].astype(np.uint64) >> np.uint64(32)
        slot = base[own] + segment.astype(np.int64)
        value = mixed(element + _SPLIT)
        subset = np.zeros(int(count.sum()), np.uint64)
        np.add.at(subset, slot, value)
        slots = np.arange(len(subset))
        by = np.repeat(np.arange(len(takes)), count)
        at = slots - base[by]
        threshold = self.thresholds[self.start[scheme[by]] + at]
        salt = mixed(self.names[scheme[by]] ^ (at.astype(np.uint64) << np.uint64(16)))
        whole = np.flatnonzero(threshold >= 0)
        less = np.flatnonzero(threshold[slot] == 1)
        keys = np.concatenate([mixed(subset[whole] ^ salt[whole]), mixed(subset[slot[less]] - value[less] ^ salt[slot[less]])])
        slot = np.concatenate([whole, slot[less]])
        return takes[by[slot]], keys.view(np.int64), scheme[by[slot]], at[slot], threshold[slot]


# --- the join --------------------------------------------------------------------------------------------


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows ``key, salt, fp`` in order: each print with the least of its key and salt; ``key`` is set where that
    least itself must meet those of other salts."""
    at, least = None, 0
    for batch in batches:
        key, salt, fp = (np.asarray(c) for c in batch.columns)
        if not len(key):
            continue
        new = np.concatenate([[at != (key[0], salt[0])], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])
        place = np.where(new, np.arange(len(key)), -1)
        place = np.maximum.accumulate(place)
        first = np.where(place >= 0, fp[np.maximum(place, 0)], least)
        again = np.concatenate([[False], (fp[1:] == fp[:-1]) & ~new[1:]])
        linked = (fp != first) & ~again
        heads = new & (salt >= 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([fp[linked], fp[heads]])), pa.array(np.concatenate([first[linked], fp[heads]])),
             pa.array(np.concatenate([key[linked], key[heads]]), mask=np.concatenate([np.ones(int(linked.sum()), bool), np.zeros(int(heads.sum()), bool)]))],
            ["a", "b", "key"])
        at, least = (key[-1], salt[-1]), first[-1]


def _sample_shares(own: DataFrame, schemes: list[list[Scheme]], bands: int, percent: int, size: int):
    """Keys of a sample of texts under the schemes of several plans: how often sets of it meet, and keys that many share."""
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makers = [Keys(s, bands) for s in schemes if s]
        for batch in batches:
            sets = shingle_sets(batch.column(0), size)
            band = band_of(np.array([len(s) for s in sets], np.int64), percent)
            prints = np.array([set_print(s) for s in sets], np.int64)
            for maker in makers:
                owner, key, scheme, segment, t = maker(sets, band)
                names = maker.names[scheme].astype(np.int64)
                count = maker.count[scheme]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names >> 40), pa.array(count), pa.array(np.where(count <= OWN_COST, segment, -1)), pa.array(t), pa.array(key), pa.array(prints[owner])],
                    ["band", "m", "segment", "t", "key", "fp"])

    rows = own.mapInArrow(keyed, "band long, m long, segment long, t long, key long, fp long")
    by = ["band", "m", "segment", "t"]
    met = rows.groupBy(*by, "key").agg(F.count_distinct("fp").alias("c")).where("c > 1")
    return written(met.groupBy(*by).agg(F.sum(F.expr("c * (c - 1) / 2")).alias("pairs")), "met")


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, size: int = SIZE, schemes: Callable | None = None,
            parity_block: int = PARITY_BLOCK, set_block: int = SET_BLOCK, hot: int = HOT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row: the size of its set of ``size``-word shingles and the smallest key
    that can be reached over pairs of similarity ``percent`` or more, itself included.

    Equal sets are one member, whatever rows repeat them. A text without words (null, empty, blank) has an empty set and
    is linked with nothing. Rows that repeat a key each count; rows without one get the component of their set, null if
    no row of it has a key. Other columns do not matter. Sets are told apart by 64 bits, as are shingles.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[key].dataType
    own = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("t"))

    @F.arrow_udf(struct_of(fp=LongType(), n=LongType(), band=IntegerType(), parity=BinaryType()))
    def printed(texts: pa.Array) -> pa.Array:
        sets = shingle_sets(texts, size)
        sizes = np.array([len(s) for s in sets], np.int64)
        return pa.StructArray.from_arrays(
            [pa.array([set_print(s) for s in sets], pa.int64()), pa.array(sizes), pa.array(band_of(sizes, percent), pa.int32()),
             pa.array([p.tobytes() for p in parities(sets)], pa.binary())], ["fp", "n", "band", "parity"])

    prints = written(own.select("doc_id", printed("t").alias("x")).select("doc_id", "x.*"), "prints")
    points = written(prints.where("n > 0").groupBy("fp").agg(
        F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("band").alias("band"), F.first("parity").alias("parity")), "points")
    # One row per band: as many as the logarithm of the longest text.
    rows = points.groupBy("band").agg(F.count("*").alias("c"), F.avg("n").alias("mean")).collect()
    counts, mean = {r.band: r.c for r in rows}, {r.band: r.mean for r in rows}
    bands = max(counts, default=0) + 1
    hot_keys = np.zeros(0, np.int64)
    if schemes:
        chosen = schemes(counts, percent)
    else:
        sample = written(few_by_hash(own.where(F.col("doc_id").isNotNull()), "doc_id", PLAN_SAMPLE).select("t"), "sample")
        chosen, hot_keys = _planned(sample, counts, mean, bands, percent, size, hot)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen = Keys(chosen, bands), set()
        for batch in batches:
            sets = shingle_sets(batch.column(0), size)
            names = [set_print(s) for s in sets]
            # Copies within a task are met once; what a task remembers is bounded.
            fresh = [i for i, p in enumerate(names) if p and p not in seen and not seen.add(p)]
            if len(seen) > _SEEN:
                seen.clear()
            sets = [sets[i] for i in fresh]
            prints_ = np.array([names[i] for i in fresh], np.int64)
            owner, key_, _, _, _ = make(sets, band_of(np.array([len(s) for s in sets], np.int64), percent))
            fp = prints_[owner]
            salt = np.where(np.isin(key_, hot_keys), (fp % SALTS).astype(np.int64), -1)
            yield pa.RecordBatch.from_arrays([pa.array(key_), pa.array(salt.astype(np.int32)), pa.array(fp)], ["key", "salt", "fp"])

    met = own.select("t").mapInArrow(keyed, "key long, salt int, fp long").repartition("key", "salt").sortWithinPartitions("key", "salt", "fp")
    stars = written(met.mapInArrow(_stars, "a long, b long, key long"), "stars")
    heads = stars.where("key IS NOT NULL").select("key", "a")  # at most SALTS rows of a key
    tops = heads.join(heads.groupBy("key").agg(F.min("a").alias("b")), "key").select("a", "b")
    loose = components(stars.where("key IS NULL").select("a", "b").unionByName(tops))

    members = written(lookup_join(points, grouped(loose), ["fp"]).select("root", F.col("fp").alias("node"), "n", F.col("parity").alias("payload")), "members")
    close = written(grouped(components(crowd_links(members, compared(by_parity, percent), parity_block))), "close")
    owners = written(points.select("fp", F.col("id").alias("owner")).join(close, "fp"), "owners")

    @F.arrow_udf(struct_of(fp=LongType(), hashes=BinaryType()))
    def whole(texts: pa.Array) -> pa.Array:
        sets = shingle_sets(texts, size)
        return pa.StructArray.from_arrays(
            [pa.array([set_print(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["fp", "hashes"])

    # Rows of the keys that own a set, and rows without a key; a key that repeats brings other texts along, whose
    # prints tell which set they are, if any.
    keys = owners.where("owner IS NOT NULL").select(F.col("owner").alias("doc_id")).distinct()
    rows = lookup_join(own.where("doc_id IS NOT NULL"), keys.hint("shuffle_hash"), ["doc_id"], "left_semi")
    if not owners.where("owner IS NULL").isEmpty():
        rows = rows.unionByName(own.where("doc_id IS NULL"))
    texts = lookup_join(rows.select(whole("t").alias("x")).select("x.*"), owners.select("fp", "root"), ["fp"])
    sets = written(texts.groupBy("fp", "root").agg(F.first("hashes").alias("payload")).select(
        "root", F.col("fp").alias("node"), (F.length("payload") / 8).cast("long").alias("n"), "payload"), "sets")
    reached = grouped(components(crowd_links(sets, compared(by_sets, percent), set_block)))
    ids = points.select("fp", "id").join(reached, "fp")
    least = written(ids.groupBy("root").agg(F.min("id").alias("component_id")), "least")
    named = ids.select("fp", "root").join(least, "root").select("fp", "component_id")
    ends = written(points.select("fp", "id").join(named, "fp", "left").select("fp", F.coalesce("component_id", "id").alias("component_id")), "ends")
    return prints.select("doc_id", "fp", F.col("n").alias("n_shingles")).join(ends, "fp", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).cast(kind).alias("component_id"))


def _planned(sample: DataFrame, counts: dict, mean: dict, bands: int, percent: int, size: int, hot: int):
    """Schemes, and keys that many sets of the sample share under them."""
    # Every number of segments is tried once with equal subsets and once with one element less.
    trials: list[list[Scheme]] = [[] for _ in range(6)]
    for band in counts:
        if apart := most_apart(band, percent):
            for k, m in enumerate(segment_counts(apart)):
                trials[2 * k].append(Scheme(band, (0,) * m))
                trials[2 * k + 1].append(Scheme(band, (1,) * m))
    met = _sample_shares(sample, trials, bands, percent, size).where("t >= 0").collect()  # a row per segment that is met
    drawn = sample.count()
    total = max(1, sum(counts.values()))
    shares: dict[tuple[int, int, int, int], float] = {}
    for r in met:
        sets = drawn * (counts.get(r.band, 0) + counts.get(r.band + 1, 0)) / total
        shares[r.band, r.m, r.segment, r.t] = float(r.pairs) / max(1.0, sets * sets / 2) / (1 if r.segment >= 0 else r.m)
    chosen = plan(counts, mean, shares, percent)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Keys(chosen, bands)
        for batch in batches:
            sets = shingle_sets(batch.column(0), size)
            _, key, _, _, _ = make(sets, band_of(np.array([len(s) for s in sets], np.int64), percent))
            yield pa.RecordBatch.from_arrays([pa.array(key)], ["key"])

    often = sample.mapInArrow(keyed, "key long").groupBy("key").count().where(F.col("count") >= hot)
    return chosen, np.sort(np.array([r.key for r in often.collect()], np.int64))  # fewer than keys of the sample
