"""Exact cuts of texts into chunks that a byte-level BPE encodes independently.

The pre-tokenizer of such a vocabulary never puts characters from both sides of "other character,
then white space" into one piece, and looks ahead only from white space to the character after it. A
text may therefore be cut before every run of white space that follows another character, and the ids
of the text are the ids of its chunks, one after the other. Chunks repeat, texts do not: each distinct
chunk is encoded once per batch, or once per worker as long as it stays in a table of bounded size.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lakeops.llm.words import Words, encode, flat, per_worker, split_words, strings, sums

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters with the Unicode property White_Space (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")

#: Marks that start a piece of their own after a letter, in either vocabulary.
_MARKS = ".,!?;:#*$%&|"
#: A letter up to U+024F at the end, but U+0130, whose small form ends in a mark.
_LETTER_LAST = r"[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]\z"
#: Words whose text is as long in bytes once it is in lower case and composed.
_PLAIN = re.compile("[!-~\xa1-\xff]+")
REMEMBERED = 300_000
AT_ONCE = 4096


def split_chunks(texts: pa.Array) -> Words:
    """Chunks of each text; joined, they are the text.

    Cuts before every blank and line feed with Arrow. Texts where one of these follows other white
    space are cut again by a pattern.
    """
    texts = flat(texts)
    codes, bounds, distinct = encode(pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " "), drop_empty=False)
    if not len(texts):
        return Words(codes, bounds, pa.array([], pa.large_string()))
    codes, first = codes.copy(), bounds[:-1]
    blank, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    led = pc.if_else(pc.starts_with(distinct, "\n"), distinct, pc.binary_join_element_wise(blank, distinct, nothing))
    leading: dict[str, int] = {}
    codes[first] = [leading.setdefault(w, len(led) + len(leading)) for w in strings(distinct.take(pa.array(codes[first])))]
    chunks = pa.concat_arrays([led, pa.array(list(leading), pa.large_string())])
    open_end = np.asarray(pc.not_equal(pc.utf8_rtrim(chunks, WHITE), chunks))[codes]
    open_end[bounds[1:] - 1] = False
    odd = np.flatnonzero(sums(open_end, bounds))
    if len(odd):
        more: dict[str, int] = {}
        parts = np.split(codes, bounds[1:-1])
        for i in odd:
            found = _CHUNK.findall(texts[int(i)].as_py())
            parts[i] = np.array([more.setdefault(c, len(chunks) + len(more)) for c in found], codes.dtype)
        chunks = pa.concat_arrays([chunks, pa.array(list(more), pa.large_string())])
        codes = np.concatenate(parts)
        bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(p) for p in parts])])
    empty = leading.get("", -1)
    keep = codes != empty
    run = np.concatenate([np.zeros(1, np.int64), np.cumsum(keep)])
    return Words(codes[keep], run[bounds], chunks)


def cores_and_marks(chunks: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Words and the marks after them, which are encoded apart; no marks where that would not be exact."""
    trimmed = pc.utf8_rtrim(chunks, _MARKS)
    cores = pc.if_else(pc.match_substring_regex(trimmed, _LETTER_LAST), trimmed, chunks)
    ends = np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset + 1: chunks.offset + len(chunks) + 1]
    sizes = np.asarray(pc.binary_length(chunks)) - np.asarray(pc.binary_length(cores))
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    data = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)[ragged(ends - sizes, sizes)]
    return cores, pa.LargeStringArray.from_buffers(len(chunks), pa.py_buffer(bounds), pa.py_buffer(data))


class Coder:
    """Ids of chunks by a tokenizers file, remembered in a table of bounded size."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        small = self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16
        self.code, self.dtype = ("H", np.dtype("<u2")) if small else ("I", np.dtype("<u4"))
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        # Bytes of text that each id stands for: in a byte-level vocabulary, a character for each byte.
        model = json.loads(self.tokenizer.to_str())["model"]
        suffix = model.get("end_of_word_suffix") or ""
        self.sizes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token.removesuffix(suffix))
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            self.sizes[i] = len(token.content.encode())

    def coded(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks in one array, and the number of ids of each chunk."""
        parts = pa.concat_arrays(cores_and_marks(chunks)).dictionary_encode()
        pieces = self.ids(strings(parts.dictionary))
        base = np.frombuffer(b"".join(pieces), self.dtype)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) // self.dtype.itemsize
        starts = np.cumsum(lengths) - lengths
        order = np.asarray(parts.indices, dtype=np.int64).reshape(2, -1).T.ravel()  # a core, its marks, the next core
        return base[ragged(starts[order], lengths[order])], lengths[order].reshape(-1, 2).sum(axis=1)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text; no text twice."""
        known = self.known
        out = [known.get(t) for t in texts]
        missing = [i for i, x in enumerate(out) if x is None]
        fresh = self._coded([texts[i] for i in missing])
        for i in missing:
            out[i] = fresh[texts[i]]
        room = self.remembered - len(known)
        if room > 0:
            known.update(fresh if len(fresh) <= room else list(fresh.items())[:room])
        return out

    def _coded(self, texts: list[str]) -> dict[str, bytes]:
        """Ids of each text. Those that lead with a blank or line feed and end otherwise may follow one another in one
        text, and so may plain words between blanks: the library makes one result for many of them."""
        fresh: dict[str, bytes] = {}
        apart, led, words = [], [], []
        for t in texts:
            if t[:1] in (" ", "\n") and not t[-1].isspace():
                led.append(t)
            elif _PLAIN.fullmatch(t):
                words.append(t)
            else:
                apart.append(t)
        for by, many in (("", led), (" ", words)):
            for at in range(0, len(many), AT_ONCE):
                part = many[at: at + AT_ONCE]
                found = self._joined(part, by)
                if found is None:
                    apart += part
                else:
                    fresh.update(zip(part, found))
        code = self.code
        for at in range(0, len(apart), AT_ONCE):  # the library's results are far larger than the ids in them
            part = apart[at: at + AT_ONCE]
            coded = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            fresh.update((c, array(code, e.ids).tobytes()) for c, e in zip(part, coded))
        return fresh

    def _joined(self, texts: list[str], by: str) -> list[bytes] | None:
        """Ids of texts that are coded as one, cut where the bytes that the ids stand for make up a text; none if they
        don't, as in a vocabulary that keeps the blanks between words."""
        coded, = self.tokenizer.encode_batch_fast([by.join(texts)], add_special_tokens=False)
        ids = np.array(coded.ids, self.dtype)
        ends = np.cumsum(self.sizes[ids])
        wanted = np.cumsum(np.fromiter((len(t) if t.isascii() else len(t.encode()) for t in texts), np.int64, len(texts)))
        last = np.searchsorted(ends, wanted)
        if not len(ends) or ends[-1] != wanted[-1] or not np.array_equal(ends[last], wanted):
            return None
        width, data = self.dtype.itemsize, ids.tobytes()
        cuts = ((last + 1) * width).tolist()
        return [data[a:b] for a, b in zip([0, *cuts], cuts)]


def coder(path: str) -> Coder:
    """The worker's coder of a tokenizers file."""
    return per_worker(("coder", path), lambda: Coder(path))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i] + 1, ... lengths[i] of them, one group after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def encode_texts(texts: pa.Array, path: str, keeps_white: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and the number of ids of each text.

    ``keeps_white``: whether the vocabulary codes white space. One that drops it is cut into words.
    """
    words = split_chunks(texts) if keeps_white else split_words(texts)
    flat_ids, lengths = coder(path).coded(words.distinct)
    starts = np.cumsum(lengths) - lengths
    per_word = lengths[words.codes]
    return flat_ids[ragged(starts[words.codes], per_word)], sums(per_word, words.bounds)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after each text."""
    ends = np.cumsum(counts + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, end_id, np.uint32)
    mask = np.ones(len(out), bool)
    mask[ends - 1] = False
    out[mask] = ids
    return out, counts + 1
