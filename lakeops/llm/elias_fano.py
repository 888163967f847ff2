"""Elias-Fano coding of non-decreasing integers.

A list of n values below u takes about n * (2 + log2(u / n)) bits. The low bits of each value are
stored as they are, the rest as gaps in unary: value i sets bit (value >> low) + i of a bit array.
Finding value i is a select, the place of the i-th set bit; the place of every ``STEP``-th set bit is
stored, so a select reads a few words from there and no table of full-width offsets exists.
"""

from __future__ import annotations

import struct

import numpy as np

STEP = 256
_HEAD = "<QQBQQ"  # values, first value, low bits, bytes of the unary part, bytes of the low part


class EliasFano:
    def __init__(self, n: int, first: int, low: int, unary: np.ndarray, lows: np.ndarray, samples: np.ndarray):
        self.n, self.first, self.low, self.unary, self.lows, self.samples = n, first, low, unary, lows, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """``values``: non-decreasing signed 64-bit integers."""
        n = len(values)
        if not n:
            return cls(0, 0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint64))
        first = int(values[0])
        gaps = values.astype(np.int64).view(np.uint64) - np.uint64(first % (1 << 64))
        low = max(0, (int(gaps[-1]) // n).bit_length() - 1)
        places = (gaps >> np.uint64(low)) + np.arange(n, dtype=np.uint64)
        bits = np.zeros(-(-(int(places[-1]) + 1) // 64) * 64, np.uint8)
        bits[places.astype(np.int64)] = 1
        lows = ((gaps[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        return cls(n, first, low, np.packbits(bits, bitorder="little"),
                   np.packbits(lows.ravel(), bitorder="little"), places[::STEP].astype(np.uint64))

    def dump(self) -> bytes:
        head = struct.pack(_HEAD, self.n, self.first % (1 << 64), self.low, len(self.unary), len(self.lows))
        return head + self.unary.tobytes() + self.lows.tobytes() + self.samples.astype("<u8").tobytes()

    @classmethod
    def load(cls, data: bytes | memoryview, at: int = 0) -> tuple[EliasFano, int]:
        """The list stored at byte ``at``, and the first byte after it."""
        n, first, low, n_unary, n_lows = struct.unpack_from(_HEAD, data, at)
        at += struct.calcsize(_HEAD)
        unary = np.frombuffer(data, np.uint8, n_unary, at)
        lows = np.frombuffer(data, np.uint8, n_lows, at + n_unary)
        samples = np.frombuffer(data, "<u8", -(-n // STEP), at + n_unary + n_lows)
        first -= (first >> 63) << 64
        return cls(n, first, low, unary, lows, samples), at + n_unary + n_lows + 8 * len(samples)

    def _low_bits(self, i: int) -> int:
        start = i * self.low
        chunk = self.lows[start >> 3: (start + self.low + 7) >> 3].tobytes()
        return (int.from_bytes(chunk, "little") >> (start & 7)) & ((1 << self.low) - 1)

    def select(self, i: int) -> int:
        """Value i, from the nearest stored place at or before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        words = self.unary.view("<u8")
        at, left = int(self.samples[i // STEP]), i % STEP
        word = at >> 6
        bits = int(words[word]) >> (at & 63) << (at & 63)
        while (here := bits.bit_count()) <= left:
            left -= here
            word += 1
            bits = int(words[word])
        for _ in range(left):
            bits &= bits - 1
        place = (word << 6) + (bits & -bits).bit_length() - 1
        return self.first + (((place - i) << self.low) | self._low_bits(i))

    def all(self) -> np.ndarray:
        """Every value, as signed 64-bit integers."""
        places = np.flatnonzero(np.unpackbits(self.unary, bitorder="little")).astype(np.uint64)[: self.n]
        gaps = (places - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low)
        if self.low:
            bits = np.unpackbits(self.lows, count=self.n * self.low, bitorder="little").reshape(self.n, self.low)
            gaps |= (bits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return (gaps + np.uint64(self.first % (1 << 64))).view(np.int64)
