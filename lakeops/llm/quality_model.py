"""Quality grades by ordinal regression on hashed text.

Grades are ordered, so one weight vector scores a text and ordered thresholds cut the score into grades:
P(grade >= k) = logistic(score - threshold k). That gives an expected grade and a tail probability per
grade from the same weights, and selection takes the tail that matters to it.

Features are hashed words and hashed shapes of words (letters, digits and marks in runs), and whether a
word repeats the one before it, each weighted by the root of its share of the text.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType

from lakeops.llm.shared import few_by_hash
from lakeops.llm.words import Words, bounded_batches, dense, per_worker, split_words, strings, struct_of

DIMENSIONS = 1 << 16
#: Labelled rows that a model is fitted on at most; those with the smallest hashes of their keys.
FIT_ROWS = 4000
REPEAT = DIMENSIONS - 1
_RUNS = re.compile(r"(.)\1+")
_EDGE_MARKS = ".,;:!?\"'()[]*#$%&|"


def _shapes() -> dict[int, str]:
    kinds = {}
    for c in map(chr, range(0x250)):
        kinds[ord(c)] = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
    return kinds


def word_features(words: list[str]) -> np.ndarray:
    """Two hashed features per word: the bare word in lower case, and its shape."""
    shapes = per_worker(("shapes",), _shapes)
    known = per_worker(("shape features",), dict)
    if len(known) > 100_000:
        known.clear()
    out = np.empty((len(words), 2), np.int64)
    for i, w in enumerate(words):
        shape = w.translate(shapes)
        found = known.get(shape)
        if found is None:
            found = known[shape] = zlib.crc32(_RUNS.sub(r"\1", shape).encode(), 7) % (DIMENSIONS - 1)
        out[i] = zlib.crc32(w.strip(_EDGE_MARKS).lower().encode()) % (DIMENSIONS - 1), found
    return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``text, feature, value`` of every non-zero feature."""
    words: Words = split_words(texts)
    n, owner = np.diff(words.bounds), words.owner()
    table = word_features(strings(words.distinct))
    repeat = np.zeros(len(owner), bool)
    if len(owner) > 1:
        repeat[1:] = (words.codes[1:] == words.codes[:-1]) & (owner[1:] == owner[:-1])
    again = owner[repeat]
    key = np.concatenate([
        owner * DIMENSIONS + table[words.codes, 0], owner * DIMENSIONS + table[words.codes, 1], again * DIMENSIONS + REPEAT])
    codes, count = dense(key)
    found = np.zeros(count, np.int64)
    found[codes[::-1]] = key[::-1]
    text = found // DIMENSIONS
    return text, found % DIMENSIONS, np.sqrt(np.bincount(codes, minlength=count) / n[text])


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5  # of P(best grade), for selection

    def score(self, texts: pa.Array) -> np.ndarray:
        text, feature, value = features(texts)
        return np.bincount(text, self.weights[feature] * value, minlength=len(texts))

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k + 1) in column k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -500, 500)))


def fit_ordinal(
    rows: np.ndarray, features: np.ndarray, values: np.ndarray, grades: np.ndarray, n_grades: int,
    steps: int = 300, rate: float = 0.3, penalty: float = 1e-5,
) -> OrdinalModel:
    """Cumulative logit model by full-batch Adam. ``rows, features, values`` are the non-zero entries;
    grades are 0 to ``n_grades`` - 1 and are weighted so that each counts alike."""
    n = len(grades)
    counts = np.bincount(grades, minlength=n_grades)
    weight = (1 / np.maximum(counts, 1))[grades]
    weight /= max(weight.sum(), 1e-12)
    # Thresholds stay ordered because they are a first one and positive steps.
    params = np.zeros(DIMENSIONS + n_grades - 1)
    first = second = 0.0
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for step in range(1, steps + 1):
        w, shape = params[:DIMENSIONS], params[DIMENSIONS:]
        theta = np.concatenate([shape[:1], shape[:1] + np.cumsum(np.exp(shape[1:]))])
        score = np.bincount(rows, w[features] * values, minlength=n)
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        low, high = edges[grades] - score, edges[grades + 1] - score
        p_low, p_high = np.where(np.isinf(low), 0.0, logistic(low)), np.where(np.isinf(high), 1.0, logistic(high))
        p = np.maximum(p_high - p_low, 1e-9)
        d_high, d_low = p_high * (1 - p_high) / p, p_low * (1 - p_low) / p
        d_score = weight * (d_high - d_low)  # of the loss
        g_w = np.bincount(features, d_score[rows] * values, minlength=DIMENSIONS) + penalty * w
        g_theta = np.array([(weight * (d_low * (grades == k + 1) - d_high * (grades == k))).sum() for k in range(n_grades - 1)])
        g_shape = np.concatenate([[g_theta.sum()], [np.exp(shape[k]) * g_theta[k:].sum() for k in range(1, n_grades - 1)]])
        gradient = np.concatenate([g_w, g_shape])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        params = params - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    shape = params[DIMENSIONS:]
    theta = np.concatenate([shape[:1], shape[:1] + np.cumsum(np.exp(shape[1:]))])
    return OrdinalModel(params[:DIMENSIONS].astype(np.float32), theta)


#: Share of held-out clean documents that the cut for the best grade lets through, and of labelled documents held out.
CLEAN_KEPT = 0.995
HELD_OUT = 0.25
#: Deviations by which the share of documents with a feature must differ between grades.
TELLING = 5.0

#: Grade 0: low quality. Grade 1: good, but toxic. Grade 2: good.
GRADE = "CASE WHEN quality = 0 THEN 0 WHEN toxic = 1 THEN 1 ELSE 2 END"
GRADES = 3


def labelled_features(docs: DataFrame, labels: DataFrame, rows: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``grade, features, values`` of at most ``rows`` labelled documents, chosen by the hash of the key."""
    bounded_batches(docs.sparkSession)
    graded = labels.where(f"`{key}` IS NOT NULL AND quality IS NOT NULL").groupBy(key).agg(F.expr(f"min({GRADE})").alias("grade"))
    chosen = few_by_hash(graded, key, rows).withColumnRenamed(key, "labelled")

    @F.arrow_udf(struct_of(features=ArrayType(IntegerType()), values=ArrayType(FloatType())))
    def sparse(texts: pa.Array) -> pa.Array:
        owner, feature, value = features(texts)
        order = np.argsort(owner, kind="stable")
        bounds = pa.array(np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(owner, minlength=len(texts)))]).astype(np.int32))
        return pa.StructArray.from_arrays([
            pa.ListArray.from_arrays(bounds, pa.array(feature[order].astype(np.int32))),
            pa.ListArray.from_arrays(bounds, pa.array(value[order].astype(np.float32)))], ["features", "values"])

    # At most ``rows`` keys and grades are sent to the tasks.
    found = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), F.col("k") == F.col("labelled"))
    return found.select("grade", sparse("t").alias("x")).select("grade", "x.*")


def telling(owner: np.ndarray, feature: np.ndarray, grades: np.ndarray, least: float = TELLING) -> np.ndarray:
    """Which features tell low from other documents, or toxic from good ones. Words that a few toxic documents
    happen to have would drown the few that make them toxic."""
    count = np.bincount(grades, minlength=GRADES)
    have = np.stack([np.bincount(feature[grades[owner] == k], minlength=DIMENSIONS) for k in range(GRADES)])
    out = np.zeros(DIMENSIONS, bool)
    for k in range(GRADES - 1):
        a, b, n, m = have[k], have[k + 1:].sum(axis=0), count[k], count[k + 1:].sum()
        if n and m:
            p = (a + b + 1) / (n + m + 2)
            out |= np.abs(a / n - b / m) >= least * np.sqrt(p * (1 - p) * (1 / n + 1 / m))
    return out


def fit_telling(owner: np.ndarray, feature: np.ndarray, value: np.ndarray, grades: np.ndarray) -> OrdinalModel:
    """A model of the features that tell grades apart; the others weigh nothing."""
    used = telling(owner, feature, grades)
    own = used[feature]
    model = fit_ordinal(owner[own], feature[own], value[own], grades, GRADES)
    return replace(model, weights=np.where(used, model.weights, np.float32(0)))


def best_cut(tails: np.ndarray, grades: np.ndarray, share: float = CLEAN_KEPT) -> float:
    """The P(best grade) that separates best: most of the lower grades below it while ``share`` of the best
    grade reaches it, and in the middle of the gap to the lower grades if there is one. At most 0.5, which
    also holds if nothing can be told."""
    best, lower = tails[grades == GRADES - 1], tails[grades < GRADES - 1]
    if not len(best):
        return 0.5
    cut = float(np.sort(best)[int(len(best) * (1 - share))])
    below = lower[lower < cut]
    return min(0.5, (cut + float(below.max())) / 2 if len(below) else cut)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, text: str = "text", key: str = "doc_id") -> OrdinalModel:
    """A model from at most ``rows`` labelled documents. Their hashed features, not their texts, reach the
    driver: at most ``rows`` times the distinct words of a text. The cut is fitted on a quarter of them
    by a model of the others. Without labelled rows every text gets the best grade."""
    table = labelled_features(docs, labels, rows, text, key).toArrow()
    grades = np.asarray(table.column("grade").combine_chunks()).astype(np.int64)
    if not len(grades):
        return OrdinalModel(np.zeros(DIMENSIONS, np.float32), np.full(GRADES - 1, -20.0))
    lists = table.column("features").combine_chunks()
    lengths = np.diff(np.asarray(lists.offsets))
    owner = np.repeat(np.arange(len(grades)), lengths)
    feature, value = np.asarray(lists.flatten()).astype(np.int64), np.asarray(table.column("values").combine_chunks().flatten()).astype(float)
    # Rows come in any order; which are held out depends on their features alone.
    order = np.lexsort((np.bincount(owner, feature * value, minlength=len(grades)), grades))
    held = np.zeros(len(grades), bool)
    held[order[:: round(1 / HELD_OUT)]] = True
    place = np.cumsum(~held) - 1
    own = ~held[owner]
    trial = fit_telling(place[owner[own]], feature[own], value[own], grades[~held])
    scores = np.bincount(owner, trial.weights[feature] * value, minlength=len(grades))
    cut = best_cut(trial.tails(scores)[held, -1], grades[held])
    return replace(fit_telling(owner, feature, value, grades), cut=cut)


def grade(docs: DataFrame, model: OrdinalModel, at_least: int = 1, tail: float = 0.5, text: str = "text", out: str = "graded") -> DataFrame:
    """``docs`` with a struct ``out``: ``expected_grade``, ``p_ge_1``, ``p_ge_2`` and ``kept``, true where the grade
    is at least ``at_least`` with probability ``tail`` or more.

    A null or empty text has no features: it scores 0, which the thresholds judge like any score. The
    model has a fixed size and travels with the tasks. No shuffle."""
    bounded_batches(docs.sparkSession)
    fields = {"expected_grade": DoubleType(), "p_ge_1": DoubleType(), "p_ge_2": DoubleType(), "kept": BooleanType()}

    @F.arrow_udf(struct_of(**fields))
    def graded(texts: pa.Array) -> pa.Array:
        tails = model.tails(model.score(texts))
        return pa.StructArray.from_arrays(
            [pa.array(tails.sum(axis=1)), pa.array(tails[:, 0]), pa.array(tails[:, 1]), pa.array(tails[:, at_least - 1] >= tail)],
            list(fields))

    return docs.withColumn(out, graded(F.col(text)))


def keep_good(docs: DataFrame, model: OrdinalModel, at_least: int = 1, tail: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, all columns unchanged. For the best grade alone, ``at_least`` is 2
    and ``tail`` the model's cut."""
    names = set(docs.columns)
    own = next(g for g in (f"__graded{i}" for i in range(len(names) + 1)) if g not in names)
    return grade(docs, model, at_least, tail, text, own).where(f"{own}.kept").drop(own)
