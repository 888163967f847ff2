"""Groups of near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come first from SimHash: texts whose fingerprints are linked at 4 or fewer differing bits, found
as in ``simhash``. That misses copies that are less alike: at similarity 0.8 about 15 in 100 bits differ, at
any width, and an index that promises that distance meets nearly all pairs. So more candidates come from
bands of minima: texts that agree in all minima of a band share a bucket, and a pair of similarity 0.8
misses all 30 bands of 5 with a probability of 7 in a million, less if it is more alike. Texts that
fingerprints or buckets connect form a loose group; within one, similarities are exact, so nothing below the
bound links.

Only texts that share a bucket are looked at again. The members of a loose group are compared in the
tasks that hold its blocks (``crowds``), never written out as pairs; sizes and parities rule out pairs that
cannot reach the bound, sets decide the others. What leaves a task is at most one link per text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType

from lakeops.llm.components import components
from lakeops.llm.crowds import SET_BLOCK, by_sets, compared, crowd_links, grouped, set_print
from lakeops.llm.shared import written
from lakeops.llm.simhash import fingerprint_batch, first_rows, near_links
from lakeops.llm.sketches import mixed, shingle_hashes
from lakeops.llm.words import bounded_batches, split_words, struct_of
from lakeops.operators.skew import lookup_join

#: Similarity of near copies, in hundredths.
ALIKE = 80
#: Differing bits of SimHash fingerprints that are linked.
DISTANCE = 4
BANDS, ROWS = 30, 5
_FACTORS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, in order; empty for texts without words."""
    hashes, bounds = shingle_hashes(split_words(texts))
    return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def minima(sets: list[np.ndarray], count: int) -> np.ndarray:
    """The least of each of ``count`` permutations of the hashes, a row per set; no set may be empty."""
    out = np.empty((len(sets), count), np.uint64)
    if sets:
        every = np.concatenate(sets)
        starts = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(s) for s in sets])[:-1]])
        for k in range(count):
            out[:, k] = np.minimum.reduceat(every * _FACTORS[k], starts)
    return out


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """One key per band, a row per set."""
    values = minima(sets, BANDS * ROWS).reshape(len(sets), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sets), BANDS))
    for r in range(ROWS):
        keys = mixed(keys ^ values[:, :, r])
    return keys.view(np.int64)


@F.arrow_udf(struct_of(fp=LongType(), sim=LongType(), bands=ArrayType(LongType())))
def _printed(texts: pa.Array) -> pa.Array:
    sets = shingle_sets(texts)
    full = np.array([len(s) > 0 for s in sets], bool)
    keys = band_keys([s for s in sets if len(s)])
    bounds = np.concatenate([np.zeros(1, np.int32), np.cumsum(np.where(full, BANDS, 0))]).astype(np.int32)
    return pa.StructArray.from_arrays([
        pa.array([set_print(s) for s in sets], pa.int64()), pa.array(fingerprint_batch(texts).view(np.int64)),
        pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys.ravel()))], ["fp", "sim", "bands"])


@F.arrow_udf(LongType())
def _print(texts: pa.Array) -> pa.Array:
    return pa.array([set_print(s) for s in shingle_sets(texts)], pa.int64())


@F.arrow_udf(struct_of(fp=LongType(), hashes=BinaryType()))
def _set(texts: pa.Array) -> pa.Array:
    sets = shingle_sets(texts)
    return pa.StructArray.from_arrays(
        [pa.array([set_print(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["fp", "hashes"])


def near_copy_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = SET_BLOCK) -> DataFrame:
    """``doc_id, fp, component_id`` for every row with a key: the name of its shingle set, and the smallest
    name that can be reached over pairs of similarity 0.8 or more. Equal sets count as one."""
    bounded_batches(docs.sparkSession)
    own = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text).alias("t"))
    prints = written(own.select("doc_id", _printed("t").alias("x")).select("doc_id", "x.fp", "x.sim", "x.bands"), "prints")
    # Linked fingerprints share a bucket too: the smallest one that can be reached.
    points = written(prints.where(F.size("bands") > 0).select("fp", "sim").distinct(), "points")
    alike = components(near_links(written(points.select(F.col("sim").alias("id"), F.col("sim").alias("fp")).distinct(), "fingerprints"), DISTANCE))
    linked = lookup_join(points, alike.withColumnRenamed("node", "sim"), ["sim"], "left").select("fp", F.coalesce("root", "sim").alias("bucket"))
    keyed = written(prints.select("fp", F.explode("bands").alias("bucket")).unionByName(linked).distinct(), "bands")
    shared = keyed.groupBy("bucket").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least <> most")
    loose = components(lookup_join(keyed, shared, ["bucket"]).select(F.col("fp").alias("a"), F.col("least").alias("b")))
    members = written(grouped(loose), "members")
    # One row stands for each set. A key that repeats brings other texts along, whose names tell which set they are, if any.
    owners = written(lookup_join(prints.select("doc_id", "fp"), members, ["fp"]).groupBy("fp", "root").agg(F.min("doc_id").alias("doc_id")), "owners")
    texts = lookup_join(own, owners.select("doc_id").distinct().hint("shuffle_hash"), ["doc_id"], "left_semi").select(_set("t").alias("x")).select("x.*")
    sets = written(lookup_join(texts, owners.select("fp", "root"), ["fp"]).groupBy("fp", "root").agg(F.first("hashes").alias("payload")).select(
        "root", F.col("fp").alias("node"), (F.length("payload") / 8).cast("long").alias("n"), "payload"), "sets")
    reached = components(crowd_links(sets, compared(by_sets, ALIKE), block))
    return lookup_join(prints.select("doc_id", "fp"), reached.withColumnRenamed("node", "fp"), ["fp"], "left").select(
        "doc_id", "fp", F.coalesce("root", "fp").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row per group of near copies; which one, and what becomes of rows
    without a key, is as in ``simhash.first_rows``."""
    return first_rows(docs, near_copy_groups(docs, key, text), _print, key, text)
