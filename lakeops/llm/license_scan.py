"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are scored by a sparse logistic regression over hashed word unigrams and bigrams, one row of
weights per licence family and one for "unknown". Lines up to one without words form a paragraph; the
paragraph is judged as one and its lines one by one, and a paragraph that is mostly of one licence is
one finding. Temperature and weight of the unknown class are fitted on whole notices that the model has
not seen. A predicted family is confirmed only if enough of the paragraph's word bigrams occur in one
template of that family, among them one that tells it from all other families.

The model is trained here: on templates and on pieces of them, against sentences in the manner of
licences and against paragraphs of the corpus that share no run of four words with any template.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType

from lakeops.llm.licence_notices import CARRIERS, NAMES, STRANGE_NAMES, STRANGERS, TEMPLATES
from lakeops.llm.shared import few_by_hash
from lakeops.llm.words import bounded_batches, flat, split_lines, split_words, strings, struct_of

DIMENSIONS = 1 << 15
#: Documents whose paragraphs serve as examples without a licence, at most.
FIT_DOCS = 500
UNKNOWN = "unknown"

FAMILIES = (UNKNOWN, *TEMPLATES)
_MARKS = ".,;:!?\"'()[]*#$%&|<>/-"
#: Parts into which whole notices are dealt; each is left out once to calibrate the probabilities.
FOLDS = 3
#: Bigrams that a piece of a notice must share with it; a whole notice may have fewer.
LEAST_SHARED = 3
#: Share of a paragraph of several lines that must come from notices of its family.
COVERED = 0.5


def bare(word: str) -> str:
    return word.strip(_MARKS).lower()


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * 31 + b * 17 + 7) % DIMENSIONS


class Grams(NamedTuple):
    """Hashed unigrams and bigrams of paragraphs as ``paragraph, feature`` pairs; words per paragraph, and the
    hashes of its first and last (0 without words). Words of marks alone do not count."""

    paragraph: np.ndarray
    feature: np.ndarray
    size: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def scale(self) -> np.ndarray:
        return scale_of(self.size)


def scale_of(size: np.ndarray) -> np.ndarray:
    return 1 / np.sqrt(np.maximum(1, 2 * size - 1))


def grams(paragraphs: pa.Array) -> Grams:
    words = split_words(paragraphs)
    bares = [bare(w) for w in strings(words.distinct)]
    hashes = np.fromiter((zlib.crc32(w.encode()) for w in bares), np.int64, len(bares))
    keep = np.fromiter(map(bool, bares), bool, len(bares))[words.codes]
    owner, one = words.owner()[keep], hashes[words.codes[keep]]
    inside = owner[1:] == owner[:-1]
    size = np.bincount(owner, minlength=len(paragraphs))
    stop = np.cumsum(size)
    first, last = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    some = size > 0
    first[some], last[some] = one[(stop - size)[some]], one[stop[some] - 1]
    feature = np.concatenate([one % DIMENSIONS, _pair(one[:-1], one[1:])[inside]])
    return Grams(np.concatenate([owner, owner[1:][inside]]), feature, size, first, last)


@dataclass(frozen=True)
class LicenceModel:
    weights: np.ndarray  # families x (features + 1); the last column is the bias
    temperature: float
    unknown: float  # added to the score of the unknown class
    templates: dict[str, tuple[frozenset, ...]]
    telling: dict[str, frozenset]
    calibration_error: float  # of notices that the model had not seen

    def sums(self, g: Grams) -> np.ndarray:
        """Weights of all features of each paragraph, per family. Sums of lines add up to those of a paragraph."""
        return np.stack([np.bincount(g.paragraph, w[g.feature], minlength=len(g.size)) for w in self.weights], axis=1)

    def of_sums(self, sums: np.ndarray, size: np.ndarray) -> np.ndarray:
        return calibrated(sums * scale_of(size)[:, None] + self.weights[:, -1], self.temperature, self.unknown)

    def probabilities(self, paragraphs: pa.Array) -> np.ndarray:
        g = grams(paragraphs)
        return self.of_sums(self.sums(g), g.size)

    def likeness(self, paragraph: str, family: str) -> float:
        """Largest share of a notice's or the paragraph's bigrams (whichever has fewer) that both have. 0 unless
        they share ``LEAST_SHARED`` bigrams or the whole notice, one of them tells the family from all
        others, and no other family has more of its own."""
        own = bigrams(paragraph)
        marks = len(own & self.telling.get(family, frozenset()))
        if not marks or any(len(own & t) > marks for f, t in self.telling.items() if f != family):
            return 0.0
        best = 0.0
        for t in self.templates[family]:
            shared = len(own & t)
            if shared == len(t) or shared >= LEAST_SHARED:
                best = max(best, shared / min(len(own), len(t)))
        return best

    def covered(self, paragraph: str, family: str) -> float:
        """Share of the paragraph's bigrams that come from notices of the family."""
        own = bigrams(paragraph)
        return len(own & frozenset().union(*self.templates[family])) / max(1, len(own))

    def trimmed(self, lines: list[str], family: str) -> tuple[int, int]:
        """First line and end of the lines that are left without those at either end that share no bigram with
        notices of the family, neither within nor across to the next line."""
        all_of = frozenset().union(*self.templates[family])
        a, b = 0, len(lines)
        while b - a > 1 and not bigrams(f"{lines[a]} {lines[a + 1].split()[0]}") & all_of:
            a += 1
        while b - a > 1 and not bigrams(f"{lines[b - 2].split()[-1]} {lines[b - 1]}") & all_of:
            b -= 1
        return a, b


def calibrated(scores: np.ndarray, temperature: float, unknown: float) -> np.ndarray:
    scores = scores / temperature
    scores[:, 0] += unknown
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def bigrams(text: str) -> frozenset:
    words = [b for b in map(bare, text.split()) if b]
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset({(w, "") for w in words})


def pieces(notice: str, width: int = 12) -> list[str]:
    """A notice, its halves, and its lines if it is wrapped at ``width`` words: what scans meet of it."""
    words = notice.split()
    half = len(words) // 2
    cuts = [(0, len(words))]
    if half >= 4:
        cuts += [(0, half), (half, len(words))]
    if len(words) > width:
        cuts += [(a, a + width) for a in range(0, len(words) - 3, width)]
    return list(dict.fromkeys(" ".join(words[a:b]) for a, b in cuts))


def fit_softmax(
    g: Grams, kinds: np.ndarray, own: np.ndarray, n_kinds: int, steps: int = 150, rate: float = 0.1, penalty: float = 1e-4,
) -> np.ndarray:
    """Weights per kind by full-batch Adam; each kind counts alike. Features of the examples ``own`` (the notices)
    have weights of their own. All others, seen or not, share one: that of a word foreign to licences."""
    n = len(kinds)
    used = np.unique(g.feature[own[g.paragraph]])
    place = np.minimum(np.searchsorted(used, g.feature), max(len(used) - 1, 0))
    place = np.where(used[place] == g.feature, place, len(used)) if len(used) else np.zeros(len(g.feature), np.int64)
    entry, count = np.unique(g.paragraph * (len(used) + 1) + place, return_counts=True)
    owner, feature = entry // (len(used) + 1), entry % (len(used) + 1)
    value = count * g.scale()[owner]
    weight = (1 / np.maximum(1, np.bincount(kinds, minlength=n_kinds)))[kinds]
    weight /= weight.sum()
    w = np.zeros((n_kinds, len(used) + 2))  # features, the foreign word, the bias
    first, second = np.zeros_like(w), np.zeros_like(w)
    truth = np.eye(n_kinds)[kinds]
    for step in range(1, steps + 1):
        scores = np.stack([np.bincount(owner, row[feature] * value, minlength=n) + row[-1] for row in w], axis=1)
        d = (calibrated(scores, 1.0, 0.0) - truth) * weight[:, None]
        gradient = penalty * w
        for k in range(n_kinds):
            gradient[k, :-1] += np.bincount(feature, d[owner, k] * value, minlength=len(used) + 1)
            gradient[k, -1] += d[:, k].sum()
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    out = np.repeat(w[:, -2:-1], DIMENSIONS + 1, axis=1).astype(np.float32)
    out[:, used], out[:, -1] = w[:, :-2], w[:, -1]
    return out


class Examples(NamedTuple):
    texts: list[str]
    kinds: np.ndarray
    own: np.ndarray  # pieces of notices and strangers
    folds: np.ndarray


def examples(others: list[str]) -> Examples:
    """Pieces of all notices, names in the phrases that carry them, strangers and ``others``. All pieces of a
    notice are in one fold; notices of a family, and phrases of a name, are dealt to the folds in turn."""
    texts, kinds, folds = [], [], []
    for k, notices in enumerate([STRANGERS, *TEMPLATES.values()]):
        for i, notice in enumerate(notices):
            for piece in pieces(notice):
                texts.append(piece)
                kinds.append(k)
                folds.append(i % FOLDS)
    for k, names in enumerate([STRANGE_NAMES, *NAMES.values()]):
        for i, name in enumerate(names):
            for j, carrier in enumerate(CARRIERS):
                texts.append(carrier.format(name))
                kinds.append(k)
                folds.append((i + j) % FOLDS)
    return Examples(texts + others, np.array(kinds + [0] * len(others), np.int64),
                    np.arange(len(texts) + len(others)) < len(texts),
                    np.array(folds + [i % FOLDS for i in range(len(others))], np.int64))


def held_out_scores(e: Examples) -> np.ndarray:
    """Scores of every example by a model that has seen no piece of its notice."""
    out = np.zeros((len(e.texts), len(FAMILIES)))
    for fold in range(FOLDS):
        pick = lambda m: grams(pa.array([t for t, x in zip(e.texts, m) if x], pa.large_string()))
        held = e.folds == fold
        w, g = fit_softmax(pick(~held), e.kinds[~held], e.own[~held], len(FAMILIES)), pick(held)
        out[held] = np.stack([np.bincount(g.paragraph, row[g.feature], minlength=len(g.size)) for row in w], axis=1) * g.scale()[:, None] + w[:, -1]
    return out


def reliability(p: np.ndarray, kinds: np.ndarray, weight: np.ndarray, bins: int = 10) -> float:
    """Expected calibration error: mean distance of stated probability and share of right predictions, by tenths."""
    top = p.max(axis=1)
    bin_of = np.minimum((top * bins).astype(int), bins - 1)
    right = (p.argmax(axis=1) == kinds) * weight
    return float(np.abs(np.bincount(bin_of, top * weight, bins) - np.bincount(bin_of, right, bins)).sum() / weight.sum())


def train(others: list[str]) -> LicenceModel:
    """A model from notices, strangers and paragraphs without a licence. Whole notices that a trial model has
    not seen set the temperature and the weight of the unknown class; the licensed and the unknown
    count alike there. A bigram tells a family if neither other notices nor the paragraphs have it."""
    known = {run for notices in TEMPLATES.values() for n in notices for run in _runs(n, 4)}
    others = [o for o in dict.fromkeys(others) if o.strip() and not known & set(_runs(o, 4))]
    e = examples(others)
    scores = held_out_scores(e)
    weight = np.where(e.kinds > 0, 1 / max(1, (e.kinds > 0).sum()), 1 / (e.kinds == 0).sum())
    best = None
    for temperature in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8):
        for unknown in np.arange(-3.0, 3.1, 0.5).tolist():
            p = calibrated(scores.copy(), temperature, unknown)
            loss = -(weight * np.log(np.maximum(p[np.arange(len(p)), e.kinds], 1e-9))).sum()
            if best is None or loss < best[0]:
                best = (loss, temperature, unknown, reliability(p, e.kinds, weight))
    templates = {f: tuple(map(bigrams, (*notices, *NAMES[f]))) for f, notices in TEMPLATES.items()}
    common = frozenset().union(*map(bigrams, (*STRANGERS, *STRANGE_NAMES, *others)))
    telling = {f: frozenset().union(*ts) - common - frozenset().union(*(t for g, us in templates.items() if g != f for t in us))
               for f, ts in templates.items()}
    weights = fit_softmax(grams(pa.array(e.texts, pa.large_string())), e.kinds, e.own, len(FAMILIES))
    return LicenceModel(weights, best[1], best[2], templates, telling, best[3])


def _runs(text: str, n: int) -> list[tuple[str, ...]]:
    words = [bare(w) for w in text.split()]
    return list(zip(*[words[i:] for i in range(n)]))


def fit(docs: DataFrame, rows: int = FIT_DOCS, text: str = "text", key: str = "doc_id") -> LicenceModel:
    """A model for a corpus; the paragraphs of at most ``rows`` of its documents (smallest hashes of their
    keys) serve as examples without a licence. Rows without a key do not; of rows that share a key, one
    does."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    keys = few_by_hash(docs.where(F.col(key).isNotNull()).select(F.col(key).alias("k")), "k", rows).distinct()
    chosen = docs.select(F.col(key).alias("own"), lines.alias("lines")).join(F.broadcast(keys), F.col("own") == F.col("k"))
    found = chosen.groupBy("k").agg(F.min("lines").alias("lines")).orderBy("k").collect()
    return train([line for r in found for line in r.lines])


class Finding(NamedTuple):
    line: int
    start: int
    stop: int
    family: str
    probability: float
    likeness: float


def scan_batch(texts: pa.Array, model: LicenceModel, least: float, alike: float) -> list[list[Finding]]:
    """Per text, its paragraphs with a predicted and confirmed family; places in code points."""
    texts = flat(texts)
    lines = split_lines(texts)
    out: list[list[Finding]] = [[] for _ in range(len(texts))]
    g = grams(lines.distinct)
    sums, size = model.sums(g), g.size
    # Live lines have words; a line without any, or the end of a text, ends a paragraph.
    live = np.flatnonzero(size[lines.codes] > 0)
    if not len(live):
        return out
    codes, owner = lines.codes[live], lines.owner()[live]
    opens = np.ones(len(live), bool)
    opens[1:] = (np.diff(live) > 1) | (owner[1:] != owner[:-1])
    paragraph = np.cumsum(opens) - 1
    begin = np.flatnonzero(opens)
    end = np.append(begin[1:], len(live))

    def judge(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        family = p.argmax(axis=1)
        return family, np.flatnonzero((family > 0) & (p[np.arange(len(p)), family] >= least))

    of_line = model.of_sums(sums, size)
    line_family, likely = judge(of_line)
    alone = {}
    for d in likely.tolist():
        score = model.likeness(lines.distinct[d].as_py(), FAMILIES[line_family[d]])
        if score >= alike:
            alone[d] = score
    confirmed = np.zeros(len(size), bool)
    confirmed[list(alone)] = True

    # Sums of a paragraph are those of its lines and of the bigrams that bridge them.
    bridge = np.flatnonzero(~opens)
    across = _pair(g.last[codes[bridge - 1]], g.first[codes[bridge]])
    whole = np.stack([
        np.bincount(paragraph, sums[codes, k], len(begin)) + np.bincount(paragraph[bridge], w[across], len(begin))
        for k, w in enumerate(model.weights)], axis=1)
    of_whole = model.of_sums(whole, np.bincount(paragraph, size[codes], len(begin)))
    whole_family, likely_whole = judge(of_whole)
    likely_whole = likely_whole[(end - begin)[likely_whole] > 1]

    lengths = np.asarray(pc.utf8_length(lines.distinct)).astype(np.int64)[lines.codes] + 1
    places = np.cumsum(lengths) - lengths

    def finding(a: int, b: int, family: int, p: float, score: float) -> None:
        """Of the live lines from a up to b."""
        i, head = int(owner[a]), int(lines.bounds[owner[a]])
        first, last = int(live[a]), int(live[b - 1])
        out[i].append(Finding(first - head, int(places[first] - places[head]), int(places[last] + lengths[last] - 1 - places[head]),
                              FAMILIES[family], p, score))

    together = set()
    for j in likely_whole.tolist():
        a, b, k = int(begin[j]), int(end[j]), int(whole_family[j])
        if all(line_family[c] == k for c in codes[a:b][confirmed[codes[a:b]]].tolist()):
            parts = [lines.distinct[c].as_py() for c in codes[a:b].tolist()]
            text = "\n".join(parts)
            score = model.likeness(text, FAMILIES[k])
            if score >= alike and model.covered(text, FAMILIES[k]) >= COVERED:
                together.add(j)
                head, tail = model.trimmed(parts, FAMILIES[k])
                finding(a + head, a + tail, k, float(of_whole[j, k]), score)
    hits = [h for h in np.flatnonzero(confirmed[codes]).tolist() if int(paragraph[h]) not in together]
    while hits:
        run = 1
        while run < len(hits) and hits[run] == hits[0] + run and not opens[hits[run]] and line_family[codes[hits[run]]] == line_family[codes[hits[0]]]:
            run += 1
        k = int(line_family[codes[hits[0]]])
        own = [int(codes[h]) for h in hits[:run]]
        finding(hits[0], hits[0] + run, k, max(float(of_line[d, k]) for d in own), max(alone[d] for d in own))
        hits = hits[run:]
    for found in out:
        found.sort()
    return out


def scan(docs: DataFrame, model: LicenceModel, least: float = 0.3, alike: float = 0.6, text: str = "text", out: str = "licences") -> DataFrame:
    """``docs`` with an array ``out`` of findings: ``line, start, stop, family, probability, likeness``; empty
    where nothing is found, also for null and empty texts. ``line`` is the first
    line of the paragraph. Whole texts are read; the model has a fixed size. No shuffle."""
    bounded_batches(docs.sparkSession)
    kinds = {"line": IntegerType(), "start": IntegerType(), "stop": IntegerType(), "family": StringType(), "probability": DoubleType(), "likeness": DoubleType()}

    @F.arrow_udf(ArrayType(struct_of(**kinds)))
    def found(texts: pa.Array) -> pa.Array:
        types = pa.list_(pa.struct([("line", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("family", pa.string()),
                                    ("probability", pa.float64()), ("likeness", pa.float64())]))
        return pa.array([[f._asdict() for f in row] for row in scan_batch(texts, model, least, alike)], types)

    return docs.withColumn(out, found(F.col(text)))
