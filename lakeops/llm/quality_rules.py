"""Quality rules kept as a ledger of failure bits.

Every rule is evaluated once per text. The ledger holds the measurements and one bit per failed rule;
a policy is a version with a mask over those bits, so changing a policy never reads a text again, and
what a rule costs or saves under a policy is a bitwise aggregate over the few distinct bit patterns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lakeops.llm.words import bounded_batches, dense, flat, gram_codes, split_lines, split_words, struct_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_twice_words",
)

#: Rules in the order of their bits. A rule fails where its condition is true; shares are whole numbers, so the
#: same arithmetic holds in any SQL engine.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 25 * n_words"),
    ("upper_case", "100 * n_upper_words > 50 * n_words"),
    ("same_word_twice", "100 * n_twice_words > 25 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("long_words", "word_chars > 40 * n_words"),
)
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A named selection of rules; a text is kept when none of them failed."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return mask_of(self.rules)


def mask_of(rules: tuple[str, ...]) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(r) for r in rules)


POLICIES = (Policy("base", BASE), Policy("v1", BASE + ("symbols", "upper_case")), Policy("v2", tuple(n for n, _ in RULES)))
CURRENT = POLICIES[-1]


def measure_batch(texts: pa.Array) -> pa.StructArray:
    """All measurements of a batch of texts, each from one split into words and one into lines."""
    texts = flat(texts)
    words, lines = split_words(texts), split_lines(texts)
    n = len(texts)
    chars = np.asarray(pc.utf8_length(words.distinct)).astype(np.int64)
    symbols = np.zeros(len(words.distinct), np.int64)
    for s in SYMBOLS:
        symbols += np.asarray(pc.count_substring(words.distinct, s))
    upper = np.asarray(pc.match_substring_regex(words.distinct, "[A-Z]"), bool) & ~np.asarray(
        pc.match_substring_regex(words.distinct, "[a-z]"), bool)
    codes, bounds, owner = words.codes, words.bounds, words.owner()
    twice = np.zeros(len(codes), bool)
    if len(codes) > 1:
        twice[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])

    repeated = np.zeros(len(codes), bool)
    grams, count = gram_codes(codes, WINDOW)
    if count:
        inside = owner[: len(grams)] == owner[WINDOW - 1:]
        starts = np.flatnonzero(inside)
        keys, _ = dense(owner[starts].astype(np.int64) * count + grams[starts])
        starts = starts[np.bincount(keys)[keys] > 1]
        edges = np.zeros(len(codes) + 1, np.int64)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + WINDOW, -1)
        repeated = np.cumsum(edges)[:-1] > 0

    has_word = np.asarray(pc.match_substring_regex(lines.distinct, r"[^ \t-\r]"), bool)
    worded = np.flatnonzero(has_word[lines.codes]) if len(lines.codes) else np.zeros(0, np.int64)
    line_owner = lines.owner()[worded].astype(np.int64)
    keys, found = dense(line_owner * max(1, len(lines.distinct)) + lines.codes[worded])
    first = np.zeros(found, np.int64)
    first[keys[::-1]] = line_owner[::-1]
    n_worded = np.bincount(line_owner, minlength=n)
    n_distinct = np.bincount(first, minlength=n)

    columns = {
        "n_words": np.diff(bounds),
        "word_chars": words.total(chars[codes]),
        "n_symbols": words.total(symbols[codes]),
        "n_dup_lines": n_worded - n_distinct,
        "n_repeat_words": words.total(repeated),
        "n_lines": n_worded,
        "n_upper_words": words.total(upper[codes]),
        "n_twice_words": words.total(twice),
    }
    return pa.StructArray.from_arrays([pa.array(columns[m].astype(np.int64)) for m in MEASURES], list(MEASURES))


@F.arrow_udf(struct_of(**dict.fromkeys(MEASURES, LongType())))
def _measure(texts: pa.Array) -> pa.Array:
    return measure_batch(texts)


def failure_bits(of: str = "") -> Column:
    """The bits of all failed rules from columns that hold the measurements, or from fields of the struct ``of``."""
    def named(condition: str) -> str:
        return " ".join(f"{of}.{t}" if of and t in MEASURES else t for t in condition.split())

    return F.expr(" + ".join(f"IF({named(condition)}, {1 << i}L, 0L)" for i, (_, condition) in enumerate(RULES)))


def ledger(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: the key columns, all measurements and ``failed`` (bit i: rule i).

    Null and empty texts have no words and fail ``few_words``. Keys are carried as they are, null and
    repeated ones included. No shuffle: a row's entry depends on its own text alone.
    """
    bounded_batches(docs.sparkSession)
    measured = docs.select(*[F.col(k) for k in keys], _measure(F.col(text)).alias("__m"))
    return measured.select(*keys, "__m.*").withColumn("failed", failure_bits())


def judge(entries: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """Adds ``kept_<version>`` for each policy, from the bits alone."""
    return entries.withColumns({f"kept_{p.version}": F.col("failed").bitwiseAND(F.lit(p.mask)) == 0 for p in policies})


def ablation(entries: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """Per rule of a policy: how many rows fail it, and how many would be kept without it.

    Rows are first counted per bit pattern (at most 2 to the number of rules), which is all that is
    shuffled.
    """
    patterns = entries.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask_of((r,))).cast("long").alias("bit")) for r in policy.rules])
    each = patterns.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.*")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def keep_passing(docs: DataFrame, policy: Policy = CURRENT, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that pass a policy."""
    bounded_batches(docs.sparkSession)
    names = set(docs.columns)
    held = next(h for h in (f"__measured{i}" for i in range(len(names) + 1)) if h not in names)
    return docs.withColumn(held, _measure(F.col(text))).where(failure_bits(held).bitwiseAND(F.lit(policy.mask)) == 0).drop(held)
