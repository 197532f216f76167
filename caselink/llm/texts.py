"""Vectorised views of UTF-8 text inside Arrow batches.

Tasks read documents as Arrow batches and look at them as one byte buffer with document offsets, in
slices of a few megabytes, so that the memory of a task does not depend on the number of rows.
Words are runs of bytes other than space and U+0009 to U+000D. Hashes of byte ranges and of word
windows are polynomials modulo 2**64 with fixed odd bases, finished by a bit mixer; where a result
depends on equality, two bases give 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
#: Odd 64-bit bases of the two polynomials.
BASES = (0x9E3779B97F4A7C55, 0xD1B54A32D192ED03)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Slice:
    """Whole documents laid end to end: ``buf`` of bytes and ``offsets`` of len(rows) + 1."""

    def __init__(self, rows: np.ndarray, buf: np.ndarray, offsets: np.ndarray):
        self.rows, self.buf, self.offsets = rows, buf, offsets


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into slices of up to ``limit`` bytes; null counts as empty.

    A document longer than the limit makes a slice of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    n = len(column)
    if not n:
        return
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64 if wide else np.int32)[
        column.offset : column.offset + n + 1
    ].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n)
        yield Slice(
            np.arange(at, to), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        )
        at = to


def word_spans(part: Slice, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of each document's first word.

    ``space`` tells for each byte value whether it separates words.
    """
    inside = ~space[part.buf]
    edge = np.zeros(len(part.buf) + 1, bool)
    edge[part.offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(first, part.offsets)


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, at least ``n`` of them."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        base = BASES[which]
        both = []
        for value in (base, pow(base, -1, 1 << 64)):
            row = np.full(size, np.uint64(value))
            row[0] = 1
            both.append(np.cumprod(row, dtype=np.uint64))
        have = _POWERS[which] = (both[0], both[1])
        if size > SLICE_BYTES + 1:
            del _POWERS[which]
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of a 64-bit mixer, so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any range of a sequence of numbers, in constant time each."""

    def __init__(self, values: np.ndarray, which: int = 0):
        n = len(values)
        powers, self.inverse = _powers(which, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers[:n], dtype=np.uint64, out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])

    def windows(self, k: int) -> np.ndarray:
        """The hash of ``values[i:i + k]`` for every i."""
        m = len(self.sums) - k
        if m <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:m]) * self.inverse[:m])


def longs(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as the signed ones of the same bits."""
    return pa.array(np.ascontiguousarray(x, np.uint64).view(np.int64))


def unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
