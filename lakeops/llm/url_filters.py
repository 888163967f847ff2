"""URL filters as one bit-parallel wildcard automaton.

Every glob is a row of states in a wide word, one bit per symbol matched so far. Reading a byte shifts
all states of all globs at once and keeps those whose next symbol it fits; a star is a state that may
stay where it is. Words of 64 bits are chained by their carries, and a batch of URLs is read byte by
byte together, so the work per byte does not depend on the number of globs within a word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lakeops.llm.words import bounded_batches, struct_of

#: Between host and path in a canonical URL; no UTF-8 text contains this byte.
EDGE = b"\xff"


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and all its subdomains if the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def glob(self) -> tuple[bytes, ...]:
        return (STAR, b".", *_symbols(self.host), EDGE, *_symbols(self.path), STAR)


@dataclass(frozen=True)
class Glob:
    """Fits hosts and paths by wildcards: ``*`` any run, ``?`` any one byte."""

    verdict: str
    host: str
    path: str = "*"

    def glob(self) -> tuple[bytes, ...]:
        wild = {b"*": STAR, b"?": ANY}
        part = lambda s: tuple(wild.get(x, x) for x in _symbols(s))
        return (b".", *part(self.host), EDGE, *part(self.path))


STAR, ANY = b"any run", b"any one"


def _symbols(text: str) -> tuple[bytes, ...]:
    return tuple(bytes([b]) for b in text.encode())


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
#: What decides when no rule fits; the first that fits counts, else the URL is allowed.
GLOBS = (Glob("block", "*spam*"), Glob("block", "*pills*"), Glob("block", "*casino*"), Glob("block", "*", "*.exe"))


class Automaton:
    def __init__(self, globs: list[tuple[bytes, ...]]):
        states = [1 + sum(s is not STAR for s in g) for g in globs]
        words = max(1, -(-sum(states) // 64))
        self.fits = np.zeros((256, words), np.uint64)
        self.stays, self.start = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        self.ends: list[tuple[int, np.uint64]] = []

        def put(row: np.ndarray, bit: int) -> None:
            row[bit // 64] |= np.uint64(1 << bit % 64)

        base = 0
        for glob, n in zip(globs, states):
            at = base
            put(self.start, at)
            for symbol in glob:
                if symbol is STAR:
                    put(self.stays, at)
                    continue
                at += 1
                for b in range(256) if symbol is ANY else symbol:
                    put(self.fits[b], at)
            self.ends.append((at // 64, np.uint64(1 << at % 64)))
            base += n

    def match(self, texts: list[bytes]) -> np.ndarray:
        """Which globs (columns) fit which whole texts (rows)."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(texts), np.uint8)
        starts = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        states = np.repeat(self.start[None, :], len(texts), axis=0)
        for step in range(int(lengths[0]) if len(lengths) else 0):
            n = int(np.searchsorted(-lengths, -step, side="left"))  # texts longer than this
            now = states[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            states[:n] = (moved & self.fits[data[starts[:n] + step]]) | (now & self.stays)
        out = np.zeros((len(texts), len(self.ends)), bool)
        for g, (word, bit) in enumerate(self.ends):
            out[order, g] = states[:, word] & bit != 0
        return out


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case. Path: from there
    up to ``?``, ``#`` or the end. Both empty for null or without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def judge_batch(urls: list[str | None], rules: tuple[Rule, ...], globs: tuple[Glob, ...], automaton: Automaton):
    parts = [host_and_path(u) for u in urls]
    fits = automaton.match([b"." + h.encode() + EDGE + p.encode() for h, p in parts])
    longest = sorted(range(len(rules)), key=lambda i: -len(rules[i].name))
    names: list[str | None] = [None] * len(urls)
    verdicts = ["allow"] * len(urls)
    for g in reversed(range(len(globs))):
        for i in np.flatnonzero(fits[:, len(rules) + g]).tolist():
            verdicts[i] = globs[g].verdict
    for r in reversed(longest):
        for i in np.flatnonzero(fits[:, r]).tolist():
            names[i], verdicts[i] = rules[r].name, rules[r].verdict
    return [h for h, _ in parts], [p for _, p in parts], names, verdicts


def judge_urls(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, globs: tuple[Glob, ...] = GLOBS, key: str = "page_id", url: str = "url",
) -> DataFrame:
    """``key, host, path, rule, verdict`` for every row: the longest rule that fits (null if none) and its
    verdict, else that of the first glob, else ``allow``. A null URL, or one without ``://``, has an empty
    host and path and is judged like any other. Keys may repeat or be null. Reads two columns, no
    shuffle; the automaton is as large as the rules."""
    bounded_batches(pages.sparkSession)
    automaton = Automaton([r.glob() for r in rules] + [g.glob() for g in globs])

    @F.arrow_udf(struct_of(host=StringType(), path=StringType(), rule=StringType(), verdict=StringType()))
    def judge(urls: pa.Array) -> pa.Array:
        found = judge_batch(urls.to_pylist(), rules, globs, automaton)
        return pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in found], ["host", "path", "rule", "verdict"])

    return pages.select(F.col(key), judge(F.col(url)).alias("__v")).select(key, "__v.*")
