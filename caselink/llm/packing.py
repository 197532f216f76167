"""Conflict-constrained best-fit packing of documents into sequences of fixed capacity.

Documents are dealt into shards of a bounded number of pieces by a hash of their key, so copies and
sources spread over shards, and every shard is packed by itself: longest piece first, into the open
bin with the smallest sufficient room. Open bins are kept by room; each carries one bitmap of the
sources and one of the duplicate clusters inside it. The search starts at the first room that fits
and goes on to its successors until a bin without a conflict is found, which is the tightest
compatible one; if there is none, a new bin is opened. Documents longer than the capacity fill bins
of their own and leave a rest, so nothing is cut off or dropped.

Two pieces conflict if their documents share a duplicate cluster, or, with ``by_source``, a source.
Pieces of one document conflict likewise. Empty documents take no room and are placed with length
zero; null sources and null clusters conflict with nothing. Repeated rows are packed like different
documents of one cluster. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 4096
#: Pieces of a shard on average; bounds the memory and the search of one packing.
SHARD_PIECES = 4000


class Bins:
    """Open bins of one shard, ordered by room; bitmaps number the shard's sources and clusters."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []
        self.room: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """The bin of a piece and its start inside the bin; ``source`` and ``cluster`` are bits."""
        order, sources, clusters = self.order, self.sources, self.clusters
        at = bisect_left(order, (length, -1))
        while at < len(order):
            b = order[at][1]
            if not (sources[b] & source or clusters[b] & cluster):
                break
            at += 1
        if at < len(order):
            room, b = order.pop(at)
        else:
            room, b = self.capacity, len(self.room)
            self.room.append(room)
            sources.append(0)
            clusters.append(0)
        sources[b] |= source
        clusters[b] |= cluster
        self.room[b] = room - length
        if room > length:
            insort(order, (room - length, b))
        return b, self.capacity - room


def pack_shard(
    lengths: np.ndarray, sources: list, clusters: list, capacity: int
) -> list[tuple[int, int, int, int, int]]:
    """``(row, piece, bin, start, length)`` of all pieces of a shard."""
    pieces = []
    for row, length in enumerate(lengths.tolist()):
        whole, rest = divmod(length, capacity)
        pieces.extend((capacity, row, k) for k in range(whole))
        if rest or not whole:
            pieces.append((rest, row, whole))
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))

    def numbered(values: list) -> list[int]:
        """A bit for each value that occurs twice or more; others can't conflict."""
        seen: dict = {}
        for _, row, _ in pieces:
            if values[row] is not None:
                seen[values[row]] = seen.get(values[row], 0) + 1
        bits: dict = {}
        for v, n in seen.items():
            if n > 1:
                bits[v] = 1 << len(bits)
        return [bits.get(v, 0) if v is not None else 0 for v in values]

    source_bits, cluster_bits = numbered(sources), numbered(clusters)
    bins = Bins(capacity)
    return [
        (row, piece, *bins.place(length, source_bits[row], cluster_bits[row]), length)
        for length, row, piece in pieces
    ]


def _packer(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a partition are sorted by shard; one shard is held at a time."""
        held: list[pa.RecordBatch] = []

        def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            shard = rows.column(0)[0].as_py()
            found = pack_shard(
                rows.column(2).to_numpy(), rows.column(3).to_pylist(), rows.column(4).to_pylist(), capacity
            )
            row, piece, number, start, length = (np.array(x, np.int64) for x in zip(*found))
            ids = rows.column(1).combine_chunks().take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(piece),
                    pa.array(number + (shard << 32)),
                    pa.array(start),
                    pa.array(length),
                    pa.array([rows.column(3)[int(r)].as_py() for r in row], pa.string()),
                    pa.array([rows.column(4)[int(r)].as_py() for r in row], pa.int64()),
                ],
                names=["doc_id", "piece", "bin_id", "start", "length", "source", "cluster"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column(0).to_numpy()
            ends = np.r_[np.flatnonzero(shard[1:] != shard[:-1]) + 1, len(shard)]
            at = 0
            for end in ends:
                if held and held[0].column(0)[0].as_py() != int(shard[at]):
                    yield from settle(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(at, int(end) - at))
                at = int(end)
        if held:
            yield from settle(pa.Table.from_batches(held))

    return run


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    shard_pieces: int = SHARD_PIECES,
    by_source: bool = True,
    id_col: str = "doc_id",
) -> DataFrame:
    """``doc_id, piece, bin_id, start, length, source, cluster`` of every piece of ``docs``.

    ``docs`` has the columns id, length, source and cluster (bigint, null: in no cluster). Bin ids
    hold the shard in their upper half.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    pieces = F.greatest(F.lit(1), F.ceil(F.col("length") / capacity))
    total = docs.agg(F.sum(pieces)).first()[0] or 0
    shards = max(1, -(-int(total) // shard_pieces))
    kind = docs.schema[id_col].dataType.simpleString()
    dealt = docs.select(
        F.pmod(F.xxhash64(F.lit(11), id_col, "length", "cluster"), F.lit(shards)).alias("shard"),
        F.col(id_col).alias("doc_id"),
        F.col("length").cast("bigint").alias("length"),
        (F.col("source") if by_source else F.lit(None)).cast("string").alias("source"),
        F.col("cluster").cast("bigint").alias("cluster"),
    )
    return (
        dealt.repartition("shard")
        .sortWithinPartitions("shard", F.desc("length"), "doc_id")
        .mapInArrow(
            _packer(capacity),
            f"doc_id {kind}, piece bigint, bin_id bigint, start bigint, length bigint, source string, cluster bigint",
        )
    )


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as ``pack`` wants them: words and an end mark as length, equal texts as clusters.

    The cluster is a 64-bit hash of the lower-cased text; two texts that share one by chance are
    only kept out of each other's bins.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    words = F.when(trimmed == "", 0).otherwise(F.regexp_count(trimmed, F.lit("[\\x20\\x09-\\x0D]+")) + 1)
    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    return docs.select(
        F.col(id_col),
        (words + 1).cast("bigint").alias("length"),
        source.alias("source"),
        F.xxhash64(F.lower(text)).alias("cluster"),
    )
