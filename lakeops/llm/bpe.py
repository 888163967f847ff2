"""Byte-pair encoding and decoding with the vocabulary and merges of a tokenizers file.

A piece starts as one symbol per byte, in a doubly linked list. Every adjacent pair that a merge
exists for waits in a priority queue, by the rank of the merge and then by place. The best one is
taken; if either symbol has changed since, the entry is stale and skipped. Otherwise the two become
one and the pairs with its neighbours are queued. Decoding joins the vocabulary strings of the ids.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from lakeops.llm.chunks import WHITE, split_chunks
from lakeops.llm.words import bounded_batches, per_worker, strings, struct_of, sums

REMEMBERED = 250_000
#: Cuts text into pieces that are merged apart (fixed by the vocabulary).
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 characters
    stand for themselves, the other bytes for the characters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class BytePairs:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_characters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.byte_ids = [vocab[c] for c in letters]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items() if token not in self.special}
        self.strings |= {i: token.encode() for token, i in self.special.items()}
        named = "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
        self.cut_special = regex.compile(f"({named})") if named else None
        self.pieces = regex.compile(PIECES)
        self.remembered = remembered
        self.known_pieces: dict[str, list[int]] = {}
        self.known: dict[str, tuple[int, str, bytes]] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """Ids of one piece from the ids of its bytes."""
        n, pairs, symbol = len(symbols), self.pairs, symbols[:]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            if found := pairs.get((symbol[i], symbol[i + 1])):
                queue.append((found[0], i, symbol[i], symbol[i + 1], found[1]))
        heapify(queue)
        while queue:
            _, i, left, right, merged = heappop(queue)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue  # stale
            symbol[i], symbol[j] = merged, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := pairs.get((merged, symbol[k])):
                    heappush(queue, (found[0], i, merged, symbol[k], found[1]))
            if (p := before[i]) >= 0 and (found := pairs.get((symbol[p], merged))):
                heappush(queue, (found[0], p, symbol[p], merged, found[1]))
        return [s for s in symbol if s >= 0]

    def _piece(self, piece: str) -> list[int]:
        ids = self.known_pieces.get(piece)
        if ids is None:
            ids = self.merge([self.byte_ids[b] for b in piece.encode()])
            if len(self.known_pieces) < self.remembered:
                self.known_pieces[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a text. Strings of special tokens become their ids."""
        ids: list[int] = []
        for part in self.cut_special.split(text) if self.cut_special else [text]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for piece in self.pieces.findall(part):
                    ids += self._piece(piece)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The joined strings of the ids; bytes that are not UTF-8 become replacement characters."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")

    def chunk(self, chunk: str) -> tuple[int, str, bytes]:
        """Number of ids, ids in decimal joined by commas, and decoded bytes of a chunk."""
        found = self.known.get(chunk)
        if found is None:
            ids = self.encode(chunk)
            found = len(ids), ",".join(map(str, ids)), b"".join(map(self.strings.__getitem__, ids))
            if len(self.known) < self.remembered:
                self.known[chunk] = found
        return found


def byte_pairs(path: str) -> BytePairs:
    """The worker's coder of a tokenizers file."""
    return per_worker(("bpe", path), lambda: BytePairs(path))


def _coded(path: str, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    words = split_chunks(texts)
    own = byte_pairs(path)
    found = [own.chunk(c) for c in strings(words.distinct)]
    counts = sums(np.array([n for n, _, _ in found], np.int64)[words.codes], words.bounds)

    def joined(parts: pa.Array, by) -> pa.Array:
        lists = pa.LargeListArray.from_arrays(pa.array(words.bounds), parts.take(pa.array(words.codes)))
        return pc.binary_join(lists, by)

    ids = joined(pa.array([s for _, s, _ in found], pa.large_string()), pa.scalar(",", pa.large_string()))
    text = joined(pa.array([b for _, _, b in found], pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    return counts, ids, text


def _digests(values: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(v.as_buffer()).hexdigest() for v in values], pa.string())


def encode_decode_digest(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, number of ids, and SHA-256 of the ids (decimal, joined by commas) and of the text
    decoded from them. A null text counts as empty: no ids, digests of the empty string. Every row is
    coded by itself; keys may repeat or be null, other columns do not matter. No shuffle."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf(struct_of(n_tokens=LongType(), ids_sha256=StringType(), decoded_sha256=StringType()))
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            counts, ids, decoded = _coded(tokenizer, texts)
            yield pa.StructArray.from_arrays(
                [pa.array(counts), _digests(ids), _digests(pc.cast(decoded.cast(pa.large_string()), pa.large_binary()))],
                ["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(key), digest(F.col(text)).alias("__d")).select(key, "__d.*")


def encode_column(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of its texts as ``out`` (array of int; null texts have no ids)."""
    from pyspark.sql.types import ArrayType, IntegerType

    bounded_batches(docs.sparkSession)

    @F.arrow_udf(ArrayType(IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        own = byte_pairs(tokenizer)
        return pa.array([own.encode(t or "") for t in texts.to_pylist()], pa.list_(pa.int32()))

    return docs.withColumn(out, ids(F.col(text)))


def decode_column(docs: DataFrame, tokenizer: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of an array of ids as ``out`` (null for null)."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf(StringType())
    def text(lists: pa.Array) -> pa.Array:
        own = byte_pairs(tokenizer)
        return pa.array([None if x is None else own.decode(x) for x in lists.to_pylist()], pa.string())

    return docs.withColumn(out, text(F.col(ids)))
