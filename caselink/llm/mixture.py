"""Mixture-controlled packing: deficit round-robin over one queue of tokens per source.

The documents of a source, laid end to end, are its queue. A round credits every queue with its share
of a window of tokens; a queue that has been credited a whole quantum (a few tokens) or more sends
that many quanta on, and what is left of its credit is carried to the next round. The rounds' tokens,
one round after another, are cut into sequences. So a window holds each source's share to within
a quantum or two, whatever the order or the lengths of the documents.

Because a round credits fixed shares, the quanta that a queue has sent by the end of round w are
``floor(rate * w + start)``, with ``rate`` quanta a round and a start between 0 and 1 that is drawn
from the source. So any task knows the credit that every earlier window and partition has carried to
it, and a queue needs no scan of its own. A document is dealt to rounds where it lies; the pieces
are sorted by round once, with their ids, and the task that owns a range of rounds lays them out.
All ranges hold as many tokens, also where a source has most of the rows.

``targets`` may give sources other shares than their own. A queue that has run empty leaves the round
and the others go on at their rates, which keeps their proportions; ranges of rounds are then uneven.

A null text is a document of its end id alone; null sources are one source; repeated rows and ids are
packed as often as they occur; an empty table has no pieces. A queue's order is that of the written
rows. The last window is cut at powers of two, largest first, so no sequence needs padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caselink.llm.meeting import partitions, runs
from caselink.llm.pieces import encoder_of
from caselink.llm.texts import slices
from caselink.session import savepoint

WINDOW = 2048
QUANTUM = 16


def _encoder(path: str, end_id: int, words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = encoder_of(path, words)
        kind = np.dtype(f"<u{encoder.width}")
        if end_id >= 1 << (8 * encoder.width):
            raise ValueError("the end id does not fit the id width")
        queued: dict[str | None, int] = {}
        for batch in batches:
            for piece in slices(batch.column(2)):
                rows = batch.slice(int(piece.rows[0]), len(piece.rows))
                flat, counts = encoder.encode(piece)
                ends = np.cumsum(counts)
                raw = np.insert(flat, ends, end_id).astype(kind).tobytes()
                n = counts + 1
                cuts = np.concatenate([[0], np.cumsum(n)]) * encoder.width
                codes = rows.column(1).dictionary_encode(null_encoding="encode")
                code, names = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary.to_pylist()
                order = np.argsort(code, kind="stable")
                total = np.cumsum(n[order]) - n[order]
                first = runs(code[order])
                size = np.diff(np.r_[first, len(order)])
                before = np.empty(len(n), np.int64)
                start = np.array([queued.get(names[c], 0) for c in code[order][first].tolist()], np.int64)
                before[order] = total + np.repeat(start - total[first], size)
                for c, s, more in zip(code[order][first].tolist(), start.tolist(), np.add.reduceat(n[order], first).tolist()):
                    queued[names[c]] = s + more
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        rows.column(1),
                        pa.array(np.full(len(n), part, np.int32)),
                        pa.array(before),
                        pa.array(n),
                        pa.array([raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.binary()),
                    ],
                    names=["doc_id", "source", "part", "before", "n", "ids"],
                )

    return run


def tokenised(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    words: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``doc_id, source, part, before, n, ids``, written once: the ids of each document with its end id.

    ``before`` counts the tokens of the same source that the task ``part`` has written earlier.
    ``words`` says that the tokenizer drops white space, as opposed to a byte-level one.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text")
    )
    schema = f"doc_id {kind}, source string, part int, before bigint, n bigint, ids binary"
    return savepoint(rows.mapInArrow(_encoder(tokenizer, end_id, words), schema), "token_rows")


def queues(tokens: DataFrame, targets: DataFrame | None = None, window: int = WINDOW, quantum: int = QUANTUM) -> DataFrame:
    """``source, part, base, quanta, rate, start``: where a task's rows lie in the queue of a source,
    how many quanta the queue has, and how it is served."""
    held = savepoint(tokens.groupBy("source", "part").agg(F.sum("n").alias("n")), "queue_parts")
    whole = held.groupBy("source").agg(F.sum("n").alias("total"))
    tokens_of_all = held.agg(F.sum("n")).first()[0] or 1
    share = F.col("total") / F.lit(float(tokens_of_all))
    if targets is not None:
        given = targets.select(F.col("source").alias("_source"), F.col("share").cast("double").alias("_share"))
        whole = whole.join(given, F.col("source").eqNullSafe(F.col("_source")), "left")
        share = F.coalesce("_share", share)
    quanta = F.ceil(F.col("total") / quantum)
    # Quanta a round: the share of a window, in quanta of the queue's own mean size.
    rate = share * window * quanta / F.col("total")
    start = (F.pmod(F.xxhash64(F.lit(13), "source"), F.lit(1 << 20)) + 0.5) / float(1 << 20)
    served = whole.select(
        F.col("source").alias("_queue"), quanta.cast("bigint").alias("quanta"), rate.alias("rate"), start.alias("start")
    )
    base = F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")
    placed = held.withColumn("base", base).join(served, F.col("source").eqNullSafe(F.col("_queue")))
    return savepoint(placed.select("source", "part", "base", "quanta", "rate", "start"), "queues")


def sent(rounds: np.ndarray, rate: np.ndarray, start: np.ndarray, quanta: np.ndarray) -> np.ndarray:
    """Quanta that a queue has sent before round ``rounds``."""
    passed = np.floor(rounds * rate + start)
    return np.where(rounds <= 0, 0, np.minimum(passed, quanta)).astype(np.int64)


def round_of(quantum: np.ndarray, rate: np.ndarray, start: np.ndarray, quanta: np.ndarray) -> np.ndarray:
    """The round in which a queue sends its quantum: the last before which it has not sent it."""
    at = np.maximum(np.floor((quantum + 1 - start) / rate).astype(np.int64) - 1, 0)
    # The division may be off by a rounding error; sent() alone decides.
    while (late := sent(at, rate, start, quanta) > quantum).any():
        at = at - late
    while (early := sent(at + 1, rate, start, quanta) <= quantum).any():
        at = at + early
    return at


def _dealt(batch: pa.RecordBatch, quantum: int) -> tuple[np.ndarray, ...]:
    """Row, round, place in the queue and length of each piece of the rows of a batch.

    The columns from the third on are ``before, n, base, quanta, rate, start``.
    """
    before, n, base, quanta, rate, start = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2, 8))
    a = base + before
    first, last = a // quantum, (a + n - 1) // quantum
    many = last - first + 1
    row = np.repeat(np.arange(len(n)), many)
    q = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + first[row]
    at = round_of(q, rate[row], start[row], quanta[row])
    lead = runs(row, at)
    begin = np.maximum(q[lead] * quantum, a[row[lead]])
    ends = np.r_[begin[1:], 0]
    closing = np.r_[row[lead][1:] != row[lead][:-1], True] if len(lead) else np.zeros(0, bool)
    ends[closing] = (a + n)[row[lead][closing]]
    return row[lead], at[lead], begin, ends - begin


def _shard(rounds: np.ndarray, all_rounds: int, shards: int) -> np.ndarray:
    return np.minimum(rounds * shards // max(all_rounds, 1), shards - 1).astype(np.int32)


def _measure(quantum: int, all_rounds: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shards, np.int64)
        for batch in batches:
            _, rounds, _, length = _dealt(batch, quantum)
            np.add.at(total, _shard(rounds, all_rounds, shards), length)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["shard", "n"])

    return run


def _deal(quantum: int, all_rounds: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, rounds, begin, length = _dealt(batch, quantum)
            n = batch.column(3).to_numpy()
            cells = batch.column(8)
            width = len(cells[0].as_buffer()) // int(n[0]) if len(n) else 2
            start = begin - (batch.column(4).to_numpy() + batch.column(2).to_numpy())[row]
            raw = [memoryview(c.as_buffer()) for c in cells]
            ids = [
                raw[r][a:b].tobytes()
                for r, a, b in zip(row.tolist(), (start * width).tolist(), ((start + length) * width).tolist())
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_shard(rounds, all_rounds, shards)),
                    pa.array(rounds),
                    batch.column(1).take(pa.array(row)),
                    pa.array(begin),
                    batch.column(0).take(pa.array(row)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(n[row]),
                    pa.array(ids, pa.binary()),
                ],
                names=["shard", "round", "source", "place", "doc_id", "start", "length", "doc_tokens", "ids"],
            )

    return run


class Sequences:
    """Maps places in the stream of all rounds to sequences: whole windows, then powers of two."""

    def __init__(self, total: int, window: int):
        self.whole, self.window = total // window, window
        left, at, starts = total % window, self.whole * window, []
        while left:
            size = 1 << (left.bit_length() - 1)
            starts.append(at)
            at, left = at + size, left - size
        self.starts = np.array([*starts, at], np.int64)

    def of(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequence, offset there and tokens left there, for each place."""
        sequence, offset = np.divmod(place, self.window)
        left = self.window - offset
        tail = sequence >= self.whole
        k = np.searchsorted(self.starts, place[tail], "right") - 1
        sequence[tail] = self.whole + k
        offset[tail] = place[tail] - self.starts[k]
        left[tail] = self.starts[np.minimum(k + 1, len(self.starts) - 1)] - place[tail]
        return sequence, offset, left


def _lay(bases: np.ndarray, total: int, window: int):
    sequences = Sequences(total, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if at is None:
                at = int(bases[batch.column(0)[0].as_py()])
            length = batch.column(4).to_numpy()
            place = at + np.cumsum(length) - length
            at += int(length.sum())
            # A piece over the end of its sequence is cut there, as often as needed.
            row, begin = np.arange(len(length)), np.zeros(len(length), np.int64)
            parts = []
            while len(row):
                sequence, offset, left = sequences.of(place[row] + begin)
                taken = np.minimum(length[row] - begin, left)
                parts.append((row, begin, taken, sequence, offset))
                more = begin + taken < length[row]
                row, begin = row[more], (begin + taken)[more]
            row, begin, taken, sequence, offset = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((begin, row))
            row, begin, taken, sequence, offset = (x[order] for x in (row, begin, taken, sequence, offset))
            cells = batch.column(6)
            width = len(cells[0].as_buffer()) // int(length[0])
            raw = [memoryview(c.as_buffer()) for c in cells]
            ids = [
                raw[r][a:b]
                for r, a, b in zip(row.tolist(), (begin * width).tolist(), ((begin + taken) * width).tolist())
            ]
            flat = np.frombuffer(b"".join(ids), f"<u{width}").astype("<u4")
            wide = memoryview(flat).cast("B")
            cuts = (4 * np.concatenate([[0], np.cumsum(taken)])).tolist()
            crc = [zlib.crc32(wide[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1).take(pa.array(row)),
                    pa.array(batch.column(3).to_numpy()[row] + begin),
                    pa.array(taken),
                    pa.array(crc, pa.int64()),
                    pa.array(batch.column(5).to_numpy()[row]),
                    pa.array(sequence),
                    pa.array(offset),
                    batch.column(2).take(pa.array(row)),
                    pa.array([x.tobytes() for x in ids], pa.binary()),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "ids"],
            )

    return run


def pack_tokens(
    tokens: DataFrame, targets: DataFrame | None = None, window: int = WINDOW, quantum: int = QUANTUM
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, ids`` of every piece.

    ``tokens`` comes from ``tokenised``; ``ids`` holds little-endian numbers of 16 or 32 bits.
    ``targets`` has rows ``(source, share)``; sources that it leaves out, and all by default, are
    served in proportion to their tokens.
    """
    if window < 1 or window & (window - 1) or quantum < 1:
        raise ValueError("the window must be a power of two, the quantum positive")
    kind = tokens.schema["doc_id"].dataType.simpleString()
    served = queues(tokens, targets, window, quantum)
    rounds = served.agg(F.max(F.ceil((F.col("quanta") - F.col("start")) / F.col("rate")))).first()[0] or 0
    all_rounds, shards = int(rounds) + 1, partitions(tokens)
    narrow = tokens.withColumnsRenamed({"source": "_source", "part": "_part"}).join(
        served, F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part"))
    )
    columns = ["doc_id", "source", "before", "n", "base", "quanta", "rate", "start"]
    measured = narrow.select(*columns).mapInArrow(_measure(quantum, all_rounds, shards), "shard int, n bigint")
    sizes = np.zeros(shards, np.int64)
    for row in measured.groupBy("shard").agg(F.sum("n").alias("n")).collect():  # one row per partition
        sizes[row.shard] = row.n
    dealt = narrow.select(*columns, "ids").mapInArrow(
        _deal(quantum, all_rounds, shards),
        f"shard int, round bigint, source string, place bigint, doc_id {kind}, start bigint, length bigint, "
        "doc_tokens bigint, ids binary",
    )
    laid = dealt.repartitionById(shards, "shard").sortWithinPartitions("round", "source", "place")
    return laid.select("shard", "doc_id", "source", "start", "length", "doc_tokens", "ids").mapInArrow(
        _lay(np.cumsum(sizes) - sizes, int(sizes.sum()), window),
        f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
        "offset bigint, source string, ids binary",
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, pieces``: each sequence with its pieces in order, bounded by the window."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "source", "start", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("pieces"))
