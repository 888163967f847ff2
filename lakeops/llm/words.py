"""Words of a batch of texts as integer codes, so that per-word work runs in numpy or Arrow.

A batch is what Spark hands to an Arrow function. Its size in bytes is bounded by ``bounded_batches``;
one text is never split between batches, so a batch holds at least one whole text however long it is.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from types import ModuleType
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.types import DataType, StructField, StructType

BATCH_BYTES = 4 << 20
BATCH_ROWS = 8192


def bounded_batches(spark: SparkSession, mb: int = BATCH_BYTES, rows: int = BATCH_ROWS) -> None:
    """Let Spark cut Arrow batches by bytes, so that long texts do not pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def struct_of(**fields: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


def per_worker(key: tuple, make: Callable[[], object]):
    """Something that a Python worker makes once and keeps for all its tasks.

    This package travels to the workers by value, so globals of its modules last for one task only;
    what should last longer hangs on a module that belongs to the process.
    """
    kept = sys.modules.setdefault("_lakeops_per_worker", ModuleType("_lakeops_per_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


class Words(NamedTuple):
    """``distinct[codes[j]]`` is word j; text i owns words ``bounds[i]`` up to ``bounds[i + 1]``."""

    codes: np.ndarray
    bounds: np.ndarray
    distinct: pa.Array

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def total(self, per_word: np.ndarray) -> np.ndarray:
        """Sum over the words of each text."""
        return sums(per_word, self.bounds)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    run = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return run[bounds[1:]] - run[bounds[:-1]]


def flat(texts: pa.Array) -> pa.Array:
    """Texts without nulls (a null counts as the empty text) in one chunk."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts.cast(pa.large_string()), "")


def strings(array: pa.Array) -> list[str]:
    """A string array as Python strings, many times faster than ``to_pylist``."""
    return array.to_numpy(zero_copy_only=False).tolist()


def encode(lists: pa.Array, drop_empty: bool) -> Words:
    """Codes of the items of a list array."""
    bounds = np.asarray(lists.offsets, dtype=np.int64)
    coded = lists.flatten().dictionary_encode()
    codes, distinct = np.asarray(coded.indices), coded.dictionary
    bounds = bounds - bounds[0]
    if drop_empty:
        empty = pc.index(distinct, "").as_py() if len(distinct) else -1
        if empty >= 0:
            keep = codes != empty
            run = np.concatenate([np.zeros(1, np.int64), np.cumsum(keep)])
            codes, bounds = codes[keep], run[bounds]
    return Words(codes, bounds, distinct)


def split_words(texts: pa.Array) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text."""
    return encode(pc.ascii_split_whitespace(flat(texts)), drop_empty=True)


def split_lines(texts: pa.Array) -> Words:
    """Lines of each text, cut at every line feed; empty lines count."""
    return encode(pc.split_pattern(flat(texts), "\n"), drop_empty=False)


def dense(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Equal keys get equal codes counted from 0; exact."""
    codes, found = pd.factorize(keys)
    return codes, len(found)


def gram_codes(codes: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Code of the ``size`` words that start at each position, as far as they fit into the array.

    Codes of runs of a power of two are built by pairing, and a last overlapping pair makes up the
    rest, so two positions get one code exactly if their words are equal.
    """
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), 0
    run, count, span = codes.astype(np.int64), int(codes.max()) + 1, 1
    while span * 2 <= size:
        run, count = dense(run[:-span] * count + run[span:])
        span *= 2
    if span < size:
        gap = size - span
        run, count = dense(run[:-gap] * count + run[gap:])
    return run[:n], count
