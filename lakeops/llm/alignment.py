"""Which tokens of two vocabularies stand for the same bytes of the same texts.

Both coders cut a text into tokens; places where tokens of both end cut it into groups, and every token
of A in a group is linked with every token of B in it. How many documents of the corpus hold an id pair
linked is its count.

Fast path: an array of the vocabulary's length gives, for each A id, the B id of the same bytes. Documents
that link such a pair are counted in a vector of the same length, one vector per task. Only the other
pairs, from irregular groups, are shuffled, one row per pair and batch of documents. A batch keeps its
documents as codes of distinct chunks, so counts come back to batches, never to single occurrences.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.llm.bpe import byte_characters
from lakeops.llm.chunks import AT_ONCE, WHITE, Coder, ragged, split_chunks
from lakeops.llm.shared import written
from lakeops.llm.words import Words, bounded_batches, flat, per_worker, strings, sums

REMEMBERED = 100_000
#: Bytes of text in a batch; its links take several times as much.
BATCH_BYTES = 2 << 20
#: Bytes of a row group of batches.
BLOCK_BYTES = 8 << 20
#: Mark of a blank in the pieces of B (fixed by the vocabulary).
BLANK = "▁"
#: Texts with these are coded whole: pieces of B may reach across them.
_WHOLE = "[" + "".join(c for c in WHITE if c not in " \n") + BLANK + "]"


class Tokens(NamedTuple):
    """Ids of some chunks, one after the other, and the number of ids of each chunk."""

    ids: np.ndarray
    counts: np.ndarray


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = Coder(path_a, REMEMBERED)
        self.a.tokenizer.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {c: i for i, c in enumerate(byte_characters())}
        self.bytes_a = [b""] * self.a.tokenizer.get_vocab_size(with_added_tokens=True)
        for token, i in self.a.tokenizer.get_vocab(with_added_tokens=True).items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        single = [self.b.is_byte(i) for i in range(len(pieces))]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if s else p.replace(BLANK, " ").encode() for p, s in zip(pieces, single)]
        self.length_a, self.length_b = (np.array([len(x) for x in own], np.int64) for own in (self.bytes_a, self.bytes_b))
        # Chunks may be coded apart only if no piece has a blank after another character, or a line feed.
        self.cuts = not any(BLANK in p.lstrip(BLANK) or "\n" in p for p, s in zip(pieces, single) if not s)
        same = {}
        for i in sorted(range(len(pieces)), key=lambda i: (not single[i], -i)):
            same[self.bytes_b[i]] = i  # a piece goes before the byte of the same value, the least id before others
        self.identity = np.array([same.get(x, -1) for x in self.bytes_a], np.int64)
        self.known_b: dict[str, bytes] = {}
        # Ids as text with what follows them: A within a group and at its end, then the same of B.
        self.said = pa.array([f"{i}{mark}" for own, marks in ((self.bytes_a, ",|"), (self.bytes_b, ",;")) for mark in marks for i in range(len(own))], pa.large_string())

    def tokens_a(self, chunks: list[str]) -> Tokens:
        ids, counts = self.a.coded(pa.array(chunks, pa.large_string()))
        return Tokens(ids.astype(np.int64), counts)

    def tokens_b(self, chunks: list[str]) -> Tokens:
        """Each chunk begins with white space. The model adds a blank of its own, so one is taken off."""
        found = [self.known_b.get(c) for c in chunks]
        missing = [i for i, x in enumerate(found) if x is None]
        for at in range(0, len(missing), AT_ONCE):
            part = missing[at: at + AT_ONCE]
            led = [chunks[i][0] == " " for i in part]
            for i, blank, ids in zip(part, led, self.b.encode([chunks[i][1:] if x else chunks[i] for i, x in zip(part, led)], num_threads=1)):
                found[i] = array("H" if len(self.bytes_b) <= 1 << 16 else "I", ids if blank else ids[1:]).tobytes()
                if len(self.known_b) < REMEMBERED:
                    self.known_b[chunks[i]] = found[i]
        return self._tokens(found, np.dtype("<u2" if len(self.bytes_b) <= 1 << 16 else "<u4"))

    @staticmethod
    def _tokens(parts: list[bytes], dtype: np.dtype) -> Tokens:
        return Tokens(np.frombuffer(b"".join(parts), dtype).astype(np.int64), np.fromiter(map(len, parts), np.int64, len(parts)) // dtype.itemsize)

    def exact(self, chunks: list[str], a: Tokens, b: Tokens) -> np.ndarray:
        """Which chunks both coders leave as they are."""
        data = [c.encode() for c in chunks]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        good = np.ones(len(data), bool)
        for tokens, strings_, lengths in ((a, self.bytes_a, self.length_a), (b, self.bytes_b, self.length_b)):
            ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(tokens.counts)])
            good &= sums(lengths[tokens.ids], ends) == sizes
            said = list(map(strings_.__getitem__, tokens.ids.tolist()))
            if b"".join(said) != b"".join(data):
                good &= np.array([b"".join(said[x:y]) == d for x, y, d in zip(ends[:-1].tolist(), ends[1:].tolist(), data)], bool)
        return good


class Groups(NamedTuple):
    """Chunks by number: tokens of A and B, groups, links; their groups as text, each with a semicolon after it; and the
    id pairs of all links of all chunks, A's id in the upper 32 bits."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    text: pa.Array
    pairs: np.ndarray


def grouped(own: Aligner, a: Tokens, b: Tokens) -> Groups:
    """Of chunks that both coders leave as they are, so their ends are those of the joined bytes."""
    ends_a, ends_b = np.cumsum(own.length_a[a.ids]), np.cumsum(own.length_b[b.ids])
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    in_a, in_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
    first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    # Every A token meets the B tokens of its group.
    other = ragged(first_b[group_a], in_b[group_a])
    pairs = np.repeat(a.ids, in_b[group_a]) << 32 | b.ids[other]
    owner = np.repeat(np.arange(len(a.counts)), a.counts)
    of_group = owner[first_a]
    chunks = len(a.counts)
    n_groups = np.bincount(of_group, minlength=chunks)
    n_links = np.bincount(of_group, weights=in_a * in_b, minlength=chunks).astype(np.int64)
    # As text, the tokens of A of a group come before those of B.
    words = np.empty(len(a.ids) + len(b.ids), np.int64)
    va, vb = len(own.bytes_a), len(own.bytes_b)
    last_a, last_b = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
    last_a[first_a + in_a - 1] = 1
    last_b[first_b + in_b - 1] = 1
    words[np.arange(len(a.ids)) + first_b[group_a]] = a.ids + va * last_a
    words[np.arange(len(b.ids)) + (first_a + in_a)[group_b]] = b.ids + vb * last_b + 2 * va
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(a.counts + b.counts)])
    text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds), own.said.take(pa.array(words))), pa.scalar("", pa.large_string()))
    return Groups(a.counts, b.counts, n_groups, n_links, text, pairs)


def aligner(path_a: str, path_b: str) -> Aligner:
    return per_worker(("aligner", path_a, path_b), lambda: Aligner(path_a, path_b))


def aligned(texts: pa.Array, own: Aligner) -> tuple[np.ndarray, np.ndarray, Groups]:
    """Codes of the chunks of each text, their bounds, and the groups of the distinct chunks. Texts without tokens have
    no chunks."""
    texts = flat(texts)
    blank, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    led = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(blank, texts, nothing))
    words = split_chunks(led) if own.cuts else Words(np.arange(len(led)), np.arange(len(led) + 1), led)
    codes, bounds, distinct = words
    # Texts with white space that pieces of B may reach across, or with a chunk that a coder changes, are one chunk.
    odd = np.asarray(pc.match_substring_regex(led, _WHOLE)) if len(led) else np.zeros(0, bool)
    codes, bounds = _without(codes, bounds, odd)
    used, codes = np.unique(codes, return_inverse=True)
    chunks = strings(distinct.take(pa.array(used)))
    a, b = own.tokens_a(chunks), own.tokens_b(chunks)
    good = own.exact(chunks, a, b)
    if not good.all():
        changed = words_of(~good[codes], bounds)
        codes, bounds = _without(codes, bounds, changed)
        odd = odd | changed
    at = np.flatnonzero(odd)
    texts_ = strings(led.take(pa.array(at)))
    found = own.tokens_a(texts_), own.tokens_b(texts_)
    fits = own.exact(texts_, *found)
    a, b = (_kept(x, good, y, fits) for x, y in zip((a, b), found))
    codes = (np.cumsum(good) - 1)[codes]
    if fits.any():
        counts = np.diff(bounds)
        counts[at[fits]] = 1
        out = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
        filled = np.empty(out[-1], np.int64)
        single = np.zeros(len(filled), bool)
        single[out[at[fits]]] = True
        filled[~single], filled[single] = codes, int(good.sum()) + np.arange(int(fits.sum()))
        codes, bounds = filled, out
    return codes, bounds, grouped(own, a, b)


def words_of(marked: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which texts have a marked chunk."""
    return sums(marked, bounds) > 0


def _without(codes: np.ndarray, bounds: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same without the chunks of some texts."""
    counts = np.diff(bounds)
    return codes[~np.repeat(gone, counts)], np.concatenate([np.zeros(1, np.int64), np.cumsum(np.where(gone, 0, counts))])


def _kept(x: Tokens, good: np.ndarray, y: Tokens, fits: np.ndarray) -> Tokens:
    """Tokens of the chunks that both coders leave as they are."""
    return Tokens(np.concatenate([x.ids[np.repeat(good, x.counts)], y.ids[np.repeat(fits, y.counts)]]), np.concatenate([x.counts[good], y.counts[fits]]))


def _unique_pairs(left: np.ndarray, right: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    both = pd.unique(left * size + right)
    return both // size, both % size


def _list(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _batch_rows(path_a: str, path_b: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        held = np.zeros(len(own.identity), np.int64)  # documents of this task that link an id with its equal
        number = TaskContext.get().partitionId() << 32

        def row(keys, texts):
            codes, bounds, groups = aligned(texts, own)
            owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            place, distinct = pd.factorize(groups.pairs)
            irregular = own.identity[distinct >> 32] != (distinct & 0xFFFFFFFF)
            # Irregular pairs come first, by place; then the identity pairs, each named by its A id.
            order = np.argsort(~irregular, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            n, place, distinct = int(irregular.sum()), rank[place], distinct[order]
            starts = np.cumsum(groups.n_links) - groups.n_links
            doc, chunk = _unique_pairs(owner, codes, max(1, len(starts)))
            links = groups.n_links[chunk]
            _, linked = _unique_pairs(np.repeat(doc, links), place[ragged(starts[chunk], links)], max(1, len(distinct)))
            documents = np.bincount(linked, minlength=len(distinct))
            held[distinct[n:] >> 32] += documents[n:]
            joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds), groups.text.take(pa.array(codes))), pa.scalar("", pa.large_string()))
            shas = [hashlib.sha256(memoryview(x.as_buffer())[:-1]).hexdigest() if b > a else "" for x, a, b in zip(joined, bounds[:-1].tolist(), bounds[1:].tolist())]
            numbers = [sums(x[codes], bounds) for x in groups[:4]]
            return pa.RecordBatch.from_arrays([
                pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                *[_list(x, pa.int64()) for x in numbers], _list(np.array(shas, object), pa.string()),
                _list(np.diff(bounds), pa.int32()), _list(codes, pa.int32()), _list(groups.n_links, pa.int32()), _list(place, pa.int32()),
                _list(distinct[:n], pa.int64()), _list(documents[:n], pa.int64()), _list(distinct[n:] >> 32, pa.int32()), pa.array([None], pa.list_(pa.int64()))],
                NAMES)

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            if batch.num_rows:
                yield row(batch.column(0), batch.column(1))
                number += 1
        if kind is not None:
            last = row(pa.array([], kind), pa.array([], pa.string()))
            yield last.set_column(len(NAMES) - 1, NAMES[-1], _list(held, pa.int64()))

    return rows


#: One row per batch of documents: their keys and numbers, chunks by document, links by chunk, irregular pairs with
#: the documents that hold them, identity pairs; and, in the last row of a task only, its vector of identity pairs.
NAMES = ["batch", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "chunks", "codes", "links", "place",
         "pair", "documents", "same", "vector"]


def _finish(counts_of_a: np.ndarray, best: np.ndarray):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i].values for k, name in enumerate(batch.schema.names) if name != "batch"}

                def ints(name):
                    return np.asarray(row[name]).astype(np.int64)

                same = ints("same")
                count = np.concatenate([ints("n") if row["n"] is not None else np.zeros(0, np.int64), counts_of_a[same]])
                top = count == best[np.concatenate([ints("pair") >> 32, same])]
                place = ints("place")
                ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(ints("links"))])
                bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(ints("chunks"))])
                codes = ints("codes")
                n_best = sums(sums(top[place], ends)[codes], bounds)
                count_sum = sums(sums(count[place], ends)[codes], bounds)
                yield pa.RecordBatch.from_arrays(
                    [row["doc_id"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"], pa.array(n_best), pa.array(count_sum),
                     row["groups_sha256"]],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return finish


def _vector(rows: DataFrame, size: int) -> np.ndarray:
    """A vector of the vocabulary's length from at most as many rows ``a, n``."""
    out = np.zeros(size, np.int64)
    for r in rows.collect():
        out[r.a] = r.n
    return out


def align(docs: DataFrame, vocabulary_a: str, vocabulary_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: numbers of tokens of A and B, groups, links; ``n_best``, links whose pair has the highest
    count of all pairs of its A id; ``count_sum``, the counts of all links added up; and the SHA-256 of the groups.

    A is a byte-level vocabulary of the tokenizers library and codes a blank and the text; B is a sentencepiece
    model that adds this blank itself. Strings of special tokens are plain text. Texts that are null, empty, or that
    a coder changes have no tokens: zeros and an empty string. Rows that repeat a key, or have none, each count as a
    document. Other columns do not matter.

    The driver sees two vectors of A's length. A batch of documents is bounded in bytes, and so is what comes back to it.
    """
    spark = docs.sparkSession
    bounded_batches(spark, BATCH_BYTES)
    kind = docs.schema[key].dataType.simpleString()
    schema = (f"batch long, doc_id array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
              "groups_sha256 array<string>, chunks array<int>, codes array<int>, links array<int>, place array<int>, "
              "pair array<long>, documents array<long>, same array<int>, vector array<long>")
    batches = written(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _batch_rows(vocabulary_a, vocabulary_b), schema), "aligned", block_bytes=BLOCK_BYTES)
    size = len(aligner(vocabulary_a, vocabulary_b).identity)
    irregular = batches.where("vector IS NULL").select("batch", F.posexplode(F.arrays_zip("pair", "documents")).alias("at", "x")).select(
        "batch", "at", "x.pair", "x.documents")
    counts = written(irregular.groupBy("pair").agg(F.sum("documents").alias("n")), "pair_counts")
    identity = batches.where("vector IS NOT NULL").select(F.posexplode("vector").alias("a", "n")).where("n > 0").groupBy("a").agg(F.sum("n").alias("n"))
    best = counts.groupBy(F.shiftright("pair", 32).cast("int").alias("a")).agg(F.max("n").alias("n"))
    of_a = _vector(identity, size)
    best_of_a = np.maximum(of_a, _vector(best, size))
    # ``counts`` is a written table, so a pair that most batches hold is a skewed key of a join that Spark splits.
    filled = irregular.select("batch", "at", "pair").join(counts, "pair").groupBy("batch").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("n"))
    whole = batches.where("vector IS NULL").drop("vector", "documents").join(filled, "batch", "left")
    return whole.mapInArrow(
        _finish(of_a, best_of_a),
        f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
