"""Repeated byte strings by a run-length index.

Every window of ``WINDOW`` bytes has an anchor: its ``ANCHOR``-byte string of least hash, the leftmost
of equals. Equal windows have equal anchors at the same place, so windows are compared only where
anchors meet. Neighbouring windows with one anchor form a segment. Segments meet by hash of the
anchor, with a 64-bit hash of their own bytes: equal segments settle all their windows at once. Where
segments of an anchor differ, one of each kind is indexed.

An index is made of a few hundred kilobytes of segments: their suffixes are sorted, which gives the
Burrows-Wheeler transform. Of its runs of equal bytes only the two ends are sampled. The longest match
of a suffix with its neighbour above (below) is measured at the first (last) suffix of each run; at
every other suffix it is one less than at the text position before, since the neighbours move along
together inside a run. Streaming over the text from sample to sample so gives the matching statistics
of all segments against all others, and marks the windows whose match is long enough.

An anchor with more than ``CROWD`` different segments, such as one in a passage that very many
documents share, is not put into one index. Its windows are counted by 128-bit hashes, which are
summed where they lie before they move, and so split over all tasks.

Null and short texts lose nothing; repeated rows repeat each other's strings and lose them; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselink.llm.meeting import (
    CROWDED,
    OPEN,
    PACKED,
    REPEATED,
    Packer,
    compare,
    gather,
    meet,
    partitions,
    with_key,
)
from caselink.llm.texts import Rolling, mix, slices
from caselink.session import savepoint

WINDOW = 200
ANCHOR = 64
CROWD = 256
INDEX_BYTES = 600_000
#: Window starts of one stretch of a long document; segments are cut at its ends.
STRETCH = 2 << 20
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_PLACE = np.uint64((1 << 24) - 1)


def segments(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Rolling]:
    """First windows, last windows and anchors of all segments, as places in ``buf``."""
    n = len(buf)
    roll = Rolling(buf)
    if n < WINDOW:
        none = np.zeros(0, np.int64)
        return none, none, none, roll
    width = WINDOW - ANCHOR + 1
    least = (roll.windows(ANCHOR) & ~_PLACE) | np.arange(n - ANCHOR + 1, dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    anchor = (least & _PLACE).astype(np.int64)
    end = np.repeat(offsets[1:], np.diff(offsets))[: len(anchor)]
    start = np.flatnonzero(np.arange(len(anchor)) + WINDOW <= end)
    anchor = anchor[start]
    cut = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]) if len(start) else start
    return start[cut], start[np.r_[cut[1:], len(start)] - 1] if len(start) else start, anchor[cut], roll


def stretches(part) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """A slice, or a very long document in stretches that overlap by a window: rows, bytes, offsets
    and the place of the first byte in its document."""
    if len(part.buf) <= STRETCH + WINDOW or len(part.rows) > 1:
        yield part.rows, part.buf, part.offsets, 0
        return
    for at in range(0, len(part.buf) - WINDOW + 1, STRETCH):
        buf = part.buf[at : at + STRETCH + WINDOW - 1]
        yield part.rows, buf, np.array([0, len(buf)]), at


def _anchors(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(n_buckets)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for part in slices(batch.column(1)):
                for rows, buf, offsets, base in stretches(part):
                    first, last, anchor, roll = segments(buf, offsets)
                    if not len(first):
                        continue
                    doc = np.searchsorted(offsets, first, "right") - 1
                    context = mix(
                        Rolling(buf, 1)(first, last + WINDOW) + (anchor - first).astype(np.uint64) * _STEP
                    )
                    place = (first - offsets[doc] + base) * 256 + (last - first + 1)
                    yield from packer.add(roll(anchor, anchor + ANCHOR), context, keys[rows[doc]], place)
        yield from packer.flush()

    return run


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments that are asked for."""
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        key, spot, meeting, cells = [], [], [], []
        for i in range(batch.num_rows):
            text = texts[i].as_buffer()
            key += [batch.column(0)[i].as_py()] * len(batch.column(2)[i])
            for place in batch.column(2)[i].as_py():
                at, n = place["spot"] >> 8, place["spot"] & 255
                spot.append(place["spot"])
                meeting.append(place["meeting"])
                cells.append(text.slice(at, n - 1 + WINDOW).to_pybytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(key, pa.int64()), pa.array(spot, pa.int64()), pa.array(meeting, pa.int64()), pa.array(cells, pa.binary())],
            names=["key", "spot", "meeting", "bytes"],
        )


class RunIndex:
    """The run-compressed Burrows-Wheeler transform of some strings, with its run ends sampled."""

    HEAD = 7

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(x) for x in strings], np.int64)
        ends = np.cumsum(sizes + 1) - 1
        n = int(ends[-1]) + 1
        text = np.frombuffer(b"\x00".join(strings) + b"\x00", np.uint8).astype(np.uint64) + np.uint64(1)
        text[ends] = 0
        self.n, self.ends = n, ends
        self.string = np.repeat(np.arange(len(strings)), sizes + 1)
        self.left = ends[self.string] - np.arange(n)
        self._sort(text)
        before = np.where(self.order > 0, self.order - 1, n - 1)
        # Every end of a string is a symbol of its own: here, its place behind all bytes.
        symbol = np.where(text[before] > 0, text[before].astype(np.int64), 256 + before)
        new = symbol[1:] != symbol[:-1]
        self.heads = np.flatnonzero(np.r_[True, new])
        self.tails = np.flatnonzero(np.r_[new, True])
        self.symbols = symbol[self.heads]

    def _sort(self, text: np.ndarray) -> None:
        """Suffix order by prefix doubling; ranks of all lengths are kept to measure matches."""
        n = self.n
        padded = np.concatenate([text, np.zeros(self.HEAD, np.uint64)])
        key = np.zeros(n, np.uint64)
        for k in range(self.HEAD):
            key = (key << np.uint64(9)) | np.where(self.left >= k, padded[k : n + k], 0)
        # Prefixes that reach an end differ from all others.
        tie = np.where(self.left < self.HEAD, self.string + 1, 0)
        order = np.lexsort((tie, key))
        changed = (key[order][1:] != key[order][:-1]) | (tie[order][1:] != tie[order][:-1])
        self.text = text
        self.ranks: list[tuple[int, np.ndarray]] = []
        length = self.HEAD
        while True:
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(changed)])
            self.ranks.append((length, rank))
            if rank[order[-1]] == n - 1:
                break
            after = np.zeros(n, np.int64)
            after[: max(0, n - length)] = rank[length:]
            both = rank * n + after
            order = np.argsort(both)
            changed = both[order][1:] != both[order][:-1]
            length *= 2
        self.order = order

    def match(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of suffixes ``a`` and ``b``."""
        a, b = a.copy(), b.copy()
        out = np.zeros(len(a), np.int64)
        for length, rank in reversed(self.ranks):
            same = (a < self.n) & (b < self.n)
            same[same] = rank[a[same]] == rank[b[same]]
            step = np.where(same, length, 0)
            out, a, b = out + step, a + step, b + step
        going = np.ones(len(a), bool)
        for _ in range(self.HEAD):
            going &= (a < self.n) & (b < self.n)
            x, y = self.text[np.minimum(a, self.n - 1)], self.text[np.minimum(b, self.n - 1)]
            going &= (x == y) & (x > 0)
            out, a, b = out + going, a + going, b + going
        return out

    def _stream(self, samples: np.ndarray, step: int) -> np.ndarray:
        """Match lengths with the neighbour at ``step`` in suffix order, from sampled suffixes on."""
        near = samples + step
        inside = (near >= 0) & (near < self.n)
        at = self.order[samples]
        length = np.zeros(len(samples), np.int64)
        length[inside] = self.match(at[inside], self.order[near[inside]])
        value = np.full(self.n, -1, np.int64)
        value[at] = length + at
        held = np.where(value >= 0, np.arange(self.n), 0)
        held = np.maximum.accumulate(held)
        return np.maximum(value[held] - np.arange(self.n), 0)

    def matching_statistics(self) -> np.ndarray:
        """Per position of all strings end to end (each with its end), the longest match elsewhere."""
        return np.maximum(self._stream(self.heads, -1), self._stream(self.tails, 1))


def _marked(strings: list[bytes], spots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of marked windows of some segments: the segment, and the place code of the run."""
    index = RunIndex(strings)
    long = (index.matching_statistics() >= WINDOW) & (index.left >= WINDOW)
    edge = np.diff(np.concatenate([[0], long.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    string = index.string[first]
    begin = index.ends[string] - np.array([len(x) for x in strings])[string]
    return string, ((spots[string] >> 8) + (first - begin)) * 256 + (last - first)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index the segments of a partition, sorted by anchor, whole anchors at a time."""
    rows: list[tuple[int, int, int, bytes]] = []
    size = 0

    def settle(part: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        strings = [r[3] for r in part]
        string, code = _marked(strings, np.array([r[1] for r in part], np.int64))
        keys = np.array([r[0] for r in part], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys[string]), pa.array(code)], names=["key", "code"])

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if size >= INDEX_BYTES and row[2] != rows[-1][2]:
                yield settle(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[3]) + 1
    if rows:
        yield settle(rows)


def _single_windows(n_buckets: int):
    """All windows of the crowded segments of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(n_buckets)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for part in slices(batch.column(1)):
                strong = Rolling(part.buf), Rolling(part.buf, 1)
                for row, base in zip(part.rows, part.offsets[:-1]):
                    spots = batch.column(2)[int(row)].values.to_numpy()
                    sizes = spots & 255
                    at = np.repeat((spots >> 8) - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                    at = np.unique(at)
                    s = base + at
                    yield from packer.add(
                        strong[0](s, s + WINDOW), strong[1](s, s + WINDOW), np.full(len(s), keys[row]), at * 256 + 1
                    )
        yield from packer.flush()

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for text, codes in zip(batch.column(0).cast(pa.binary()), batch.column(1)):
            buf = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.zeros(0, np.uint8)
            n_bytes.append(len(buf))
            if not codes.is_valid or not len(codes):
                n_removed.append(0)
                n_spans.append(0)
                kept.append(buf.tobytes())
                continue
            code = codes.values.to_numpy()
            at, n = code >> 8, code & 255
            mark = np.zeros(len(buf) + 1, np.int32)
            np.add.at(mark, at, 1)
            np.add.at(mark, at + n - 1 + WINDOW, -1)
            gone = np.cumsum(mark[:-1]) > 0
            n_removed.append(int(gone.sum()))
            n_spans.append(int((gone & ~np.r_[False, gone[:-1]]).sum()))
            kept.append(buf[~gone].tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(n_bytes, pa.int64()),
                pa.array(n_removed, pa.int64()),
                pa.array(n_spans, pa.int64()),
                pa.array(kept, pa.binary()),
                batch.column(2),
            ],
            names=["n_bytes", "n_removed", "n_spans", "kept", "row"],
        )


def repeated_strings(keyed: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``key, code`` of all repeated windows of ``keyed(key, text)``: 256 * byte + number of windows."""
    n = partitions(keyed)
    texts = keyed.select("key", "text")

    def judge(*columns):
        return compare(*columns, crowd=crowd)

    def count(*columns):
        return compare(*columns, opened=False)

    places = savepoint(meet(texts.mapInArrow(_anchors(n), PACKED), judge), "segment_places")
    opened = (
        places.where(F.col("kind") == OPEN)
        .groupBy("key")
        .agg(F.collect_list(F.struct("spot", "meeting")).alias("open"))
    )
    cut = (
        texts.join(opened, "key")
        .select("key", "text", "open")
        .mapInArrow(_cut_out, "key bigint, spot bigint, meeting bigint, bytes binary")
    )
    indexed = (
        cut.repartition(n, "meeting")
        .sortWithinPartitions("meeting")
        .mapInArrow(_index, "key bigint, code bigint")
    )
    crowded = (
        texts.join(
            places.where(F.col("kind") == CROWDED).groupBy("key").agg(F.collect_list("spot").alias("spots")), "key"
        )
        .select("key", "text", "spots")
        .mapInArrow(_single_windows(n), PACKED)
    )
    whole = places.where(F.col("kind") == REPEATED)
    return (
        whole.select("key", F.col("spot").alias("code"))
        .unionByName(indexed)
        .unionByName(meet(crowded, count).select("key", F.col("spot").alias("code")))
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """``row, n_bytes, n_removed, n_spans, kept`` per document; ``row`` holds its other columns.

    ``kept`` are the bytes that stay, which need not be UTF-8, since strings are cut between bytes.
    """
    keyed = with_key(docs, id_col, text_col)
    marks = gather(repeated_strings(keyed, crowd), "codes")
    joined = keyed.join(marks, "key", "left").select("text", "codes", "row")
    row = keyed.schema["row"].dataType.simpleString()
    return joined.mapInArrow(_remove, f"n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, row {row}")
