"""Repeated word passages by difference-cover anchors.

Words at positions whose remainder modulo 21 lies in a difference cover start an anchor of 15 words.
For any two places some shift of 0 to 20 brings both onto the cover, so two equal windows of 35 words
always contain equal anchors at the same shift. Anchors meet by hash. Each carries a hash of its
context, the words of all windows it can lie in: equal contexts settle 21 windows at once. Where the
contexts of an anchor differ, one place of each is opened: its single windows are hashed with 128
bits and meet in the same way, which extends the match to its true ends.

A word is removed if a window that covers it also starts anywhere else. Windows are judged on the
input. Null texts have no words; texts of fewer than 35 words lose nothing; repeated rows repeat each
other's windows and lose them all; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselink.llm.meeting import (
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
from caselink.llm.texts import Rolling, mix, slices, word_spans
from caselink.session import savepoint

WINDOW = 35
PERIOD = 21
#: A perfect difference set modulo 21: every remainder is a difference of two of its members.
COVER = (0, 1, 6, 8, 18)
ANCHOR = WINDOW - PERIOD + 1
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def _layout(part) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, and for each word its document's row in the slice, first and last word."""
    starts, ends, first = word_spans(part)
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    return Rolling(part.buf)(starts, ends), doc, first[doc], first[doc + 1], first


def _anchors(n_buckets: int):
    on_cover = np.zeros(PERIOD, bool)
    on_cover[list(COVER)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(n_buckets)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for part in slices(batch.column(1)):
                words, doc, lo, hi, _ = _layout(part)
                at = np.arange(len(words))
                at = at[on_cover[(at - lo) % PERIOD] & (at + ANCHOR <= hi) & (hi - lo >= WINDOW)]
                low = np.maximum(lo[at], at - (PERIOD - 1))
                high = np.minimum(hi[at], at + WINDOW)
                context = mix(Rolling(words, 1)(low, high) + (at - low).astype(np.uint64) * _STEP)
                yield from packer.add(
                    Rolling(words)(at, at + ANCHOR), context, keys[part.rows[doc[at]]], at - lo[at]
                )
        yield from packer.flush()

    return run


def _windows(n_buckets: int):
    """The single windows around the opened anchors of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(n_buckets)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            opened = batch.column(2)
            for part in slices(batch.column(1)):
                words, _, _, _, first = _layout(part)
                strong = Rolling(words), Rolling(words, 1)
                for row, low, high in zip(part.rows, first[:-1], first[1:]):
                    spots = opened[int(row)].values.to_numpy()
                    last = high - low - WINDOW
                    mark = np.zeros(high - low + 2, np.int32)
                    np.add.at(mark, np.maximum(spots - (PERIOD - 1), 0), 1)
                    np.add.at(mark, np.minimum(spots, last) + 1, -1)
                    at = np.flatnonzero(np.cumsum(mark) > 0)
                    s = low + at
                    yield from packer.add(
                        strong[0](s, s + WINDOW), strong[1](s, s + WINDOW), np.full(len(s), keys[row]), at
                    )
        yield from packer.flush()

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Apply the found places of a document: ``code`` is 4 * word + kind, windows have kind 0."""
    for batch in batches:
        places = batch.column(1)
        n_words, n_removed, kept = [], [], []
        for text, codes in zip(batch.column(0).cast(pa.binary()), places):
            words = text.as_py().split() if text.is_valid else []
            n = len(words)
            n_words.append(n)
            if not codes.is_valid or not len(codes):
                n_removed.append(0)
                kept.append(b" ".join(words))
                continue
            code = codes.values.to_numpy()
            spot = code >> 2
            anchor = (code & 3) == REPEATED
            low = np.where(anchor, np.maximum(spot - (PERIOD - 1), 0), spot)
            high = np.minimum(spot + WINDOW, n)
            mark = np.zeros(n + 1, np.int32)
            np.add.at(mark, low, 1)
            np.add.at(mark, high, -1)
            stay = np.cumsum(mark[:-1]) == 0
            n_removed.append(int(n - stay.sum()))
            kept.append(b" ".join([words[i] for i in np.flatnonzero(stay)]))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(n_words, pa.int64()),
                pa.array(n_removed, pa.int64()),
                pa.array(kept, pa.binary()).cast(pa.string()),
                batch.column(2),
            ],
            names=["text", "n_words", "n_removed", "kept_text", "row"],
        )


def repeated_passages(keyed: DataFrame) -> DataFrame:
    """``key, code`` of all repeated windows of ``keyed(key, text)``: 4 * word + kind."""
    n_buckets = partitions(keyed)
    packed = keyed.select("key", "text").mapInArrow(_anchors(n_buckets), PACKED)
    places = savepoint(meet(packed), "anchor_places")
    opened = gather(places.where(F.col("kind") == OPEN).select("key", F.col("spot").alias("code")), "spots")
    windows = (
        keyed.select("key", "text").join(opened, "key").mapInArrow(_windows(n_buckets), PACKED)
    )

    def judge(*columns):
        return compare(*columns, opened=False)

    single = meet(windows, judge)
    whole = places.where(F.col("kind") == REPEATED)
    return whole.select("key", (F.col("spot") * 4 + REPEATED).alias("code")).unionByName(
        single.select("key", (F.col("spot") * 4).alias("code"))
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text, n_words, n_removed, kept_text, row`` per document; ``row`` holds its other columns.

    ``kept_text`` holds the words that stay, joined by one space.
    """
    keyed = with_key(docs, id_col, text_col)
    marks = gather(repeated_passages(keyed), "codes")
    joined = keyed.join(marks, "key", "left").select("text", "codes", "row")
    row = keyed.schema["row"].dataType.simpleString()
    return joined.mapInArrow(
        _cut, f"text string, n_words bigint, n_removed bigint, kept_text string, row {row}"
    )
