"""Elias-Fano lists of non-decreasing numbers with constant-time selection.

A number keeps its low bits in a packed array and its high bits in unary: bit ``high(i) + i`` of a
bit vector is set. Numbers up to ``u`` in a list of ``n`` take about ``2 + log2(u / n)`` bits each.
Selection finds the word of the i-th set bit by cumulative population counts of 64-bit words.
"""

from __future__ import annotations

import numpy as np


class EliasFano:
    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes):
        self.n, self.low_bits = n, low_bits
        self.low = np.frombuffer(low, np.uint8)
        self.high = np.frombuffer(high, np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.high), dtype=np.int64)])

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        shift = np.uint64(low_bits)
        bits = np.zeros((n, low_bits), np.uint8)
        for k in range(low_bits):
            bits[:, k] = (values >> np.uint64(k)) & np.uint64(1)
        place = (values >> shift).astype(np.int64) + np.arange(n)
        unary = np.zeros((int(place[-1]) // 64 + 1) * 64 if n else 0, np.uint8)
        unary[place] = 1
        return cls(
            n,
            low_bits,
            np.packbits(bits.ravel(), bitorder="little").tobytes(),
            np.packbits(unary, bitorder="little").tobytes(),
        )

    @property
    def nbytes(self) -> int:
        return len(self.low) + 8 * len(self.high)

    def _low(self, i: int) -> int:
        at = i * self.low_bits
        first, last = at // 8, (at + self.low_bits + 7) // 8
        return (int.from_bytes(self.low[first:last].tobytes(), "little") >> (at % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th number of the list."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        word = int(np.searchsorted(self.before, i, "right")) - 1
        left, bits = i - int(self.before[word]), int(self.high[word])
        for _ in range(left):
            bits &= bits - 1
        place = word * 64 + (bits & -bits).bit_length() - 1
        return ((place - i) << self.low_bits) | self._low(i)

    def all(self) -> np.ndarray:
        """All numbers, as select gives them one by one."""
        if not self.n:
            return np.zeros(0, np.int64)
        unary = np.unpackbits(self.high.view(np.uint8), bitorder="little")
        out = (np.flatnonzero(unary)[: self.n] - np.arange(self.n)) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little")
            out |= bits.reshape(self.n, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return out
