"""Bring equal keys of different documents together, many keys to a Spark row.

Operators that look for repeated pieces of text make a few (key, context) hashes per line of text.
A ``Packer`` lays those of many documents into binary columns, one row per bucket of the key;
``meet`` deals the rows by bucket and lets a judge see every key of a partition with all its
contexts. Equal (key, context) pairs of one packer load travel once, so a key that is everywhere
sends one entry per load, not one per occurrence, and no task holds more than its share of distinct
pairs. Occurrences that repeat inside a load are known to repeat; they ride along under a bucket
drawn from their document, marked ``KNOWN``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselink.llm.texts import longs, mix
from caselink.session import savepoint

PACKED = "bucket int, keys binary, contexts binary, docs binary, spots binary, often binary"
FOUND = "key bigint, spot bigint, kind int, meeting bigint"
#: Marks of packed entries: one occurrence in its load, several, or known to repeat.
ONCE, SEVERAL, KNOWN = 0, 1, 2
#: Kinds of found places: the whole context repeats; its parts must be looked at, for keys of few
#: and of many contexts.
REPEATED, OPEN, CROWDED = 1, 2, 3
LOAD = 600_000


def with_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` as ``key, text, row``: a bigint key that differs for rows of different ids or texts.

    The key is the id where it is one row's own; repeated and null ids are replaced by a hash of id
    and text. The repeated ids are written first, so that Spark joins them by their true size.
    """
    ids = docs.select(F.col(id_col).alias("id"))
    twice = savepoint(ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL"), "repeated_ids")
    boxed = docs.select(
        F.col(id_col).alias("own_id"),
        F.col(text_col).alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"),
    )
    surrogate = F.xxhash64(F.lit(7), "own_id", "text")
    if docs.schema[id_col].dataType.typeName() not in ("long", "integer", "short", "byte"):
        return boxed.select(surrogate.alias("key"), "text", "row")
    return boxed.join(twice, F.col("own_id").eqNullSafe(F.col("id")), "left").select(
        F.when(F.col("n").isNotNull() | F.col("own_id").isNull(), surrogate)
        .otherwise(F.col("own_id").cast("bigint"))
        .alias("key"),
        "text",
        "row",
    )


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of runs of equal rows."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


class Packer:
    """Gathers entries of a task and yields them as packed record batches, a load at a time."""

    def __init__(self, n_buckets: int):
        self.n_buckets = n_buckets
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, key, context, doc, spot) -> Iterator[pa.RecordBatch]:
        self.held.append((key, context, doc.astype(np.int64), spot.astype(np.int64)))
        self.size += len(key)
        if self.size >= LOAD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        key, context, doc, spot = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.size = [], 0
        order = np.argsort(mix(key ^ (context * np.uint64(0x9E3779B97F4A7C15))), kind="stable")
        first = runs(key[order], context[order])
        often = np.full(len(order), KNOWN, np.uint8)
        often[order[first]] = np.where(np.diff(np.r_[first, len(order)]) > 1, SEVERAL, ONCE)
        del order
        route = np.where(often == KNOWN, mix(doc.view(np.uint64)), key)
        bucket = (route >> np.uint64(40)).astype(np.int64) % self.n_buckets
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(self.n_buckets + 1))
        used = np.flatnonzero(cut[1:] > cut[:-1])

        def cells(x: np.ndarray) -> pa.Array:
            x = x[order]
            return pa.array([x[cut[b] : cut[b + 1]].tobytes() for b in used], pa.binary())

        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), *(cells(x) for x in (key, context, doc, spot, often))],
            names=["bucket", "keys", "contexts", "docs", "spots", "often"],
        )


def unpack(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    kinds = (np.uint64, np.uint64, np.int64, np.int64, np.uint8)
    return tuple(
        np.frombuffer(b"".join(memoryview(c.as_buffer()) for b in batches for c in b.column(i)), kind)
        for i, kind in enumerate(kinds, start=1)
    )


def found(doc: np.ndarray, spot: np.ndarray, kind: np.ndarray | int, key: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc),
            pa.array(spot),
            pa.array(np.broadcast_to(np.asarray(kind, np.int32), n)),
            longs(key) if key is not None else pa.nulls(n, pa.int64()),
        ],
        names=["key", "spot", "kind", "meeting"],
    )


def compare(
    key: np.ndarray,
    context: np.ndarray,
    doc: np.ndarray,
    spot: np.ndarray,
    often: np.ndarray,
    opened: bool = True,
    crowd: int | None = None,
) -> Iterator[pa.RecordBatch]:
    """Places whose context occurs twice or more, and one place of each context of a key that has
    several contexts: ``OPEN``, or ``CROWDED`` if there are more than ``crowd``. Every entry is one
    occurrence at least, so all counting is exact."""
    known = often == KNOWN
    if known.any():
        yield found(doc[known], spot[known], REPEATED)
        key, context, doc, spot, often = (x[~known] for x in (key, context, doc, spot, often))
    if not len(key):
        return
    order = np.lexsort((context, key))
    key, context, doc, spot, often = (x[order] for x in (key, context, doc, spot, often))
    first = runs(key, context)
    size = np.diff(np.r_[first, len(key)])
    repeated = (size > 1) | (np.add.reduceat(often.astype(np.int64), first) > 0)
    every = np.repeat(repeated, size)
    if every.any():
        yield found(doc[every], spot[every], REPEATED)
    if opened:
        contexts = np.diff(np.r_[runs(key[first]), len(first)])
        contexts = np.repeat(contexts, contexts)
        lead = first[contexts > 1]
        if len(lead):
            many = contexts[contexts > 1] > (crowd or len(key))
            yield found(doc[lead], spot[lead], np.where(many, CROWDED, OPEN), key[lead])


def meet(packed: DataFrame, judge: Callable[..., Iterator[pa.RecordBatch]] = compare, schema: str = FOUND) -> DataFrame:
    """Deal packed rows by bucket and run ``judge`` once per partition.

    Buckets are partitions: a load makes one row for each that it has entries for. A partition holds
    its distinct pairs in memory, about 30 bytes each: the number of shuffle partitions sets that
    size, as for any Spark aggregation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            columns = unpack(held)
            held.clear()
            yield from judge(*columns)

    return packed.repartitionById(partitions(packed), "bucket").mapInArrow(run, schema)


def gather(places: DataFrame, name: str) -> DataFrame:
    """``key, <name>``: the sorted places of each document, bounded by its length."""
    return places.groupBy("key").agg(F.collect_list("code").alias(name))
