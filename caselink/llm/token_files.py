"""Token-id files: one concatenated id array per block, document boundaries in Elias-Fano form.

Documents are range-partitioned and sorted by id, encoded where they then lie, and written as blocks
of about a million ids. A block holds the ids as little-endian 16-bit numbers (32-bit ones for larger
vocabularies), the document ids, and the ends of its documents as an Elias-Fano list; it needs no
table of 64-bit offsets. Blocks are rows of a parquet table, so any store that Spark writes will do.
The ids before a block are known inside its partition; the partitions' totals, one number each, are
added up when the files are read.

Encoding is that of the tokenizers library without its special tokens added (``pieces``); a special
token's own text inside a document has its one id, as in the library.

A null text is empty and has the end id alone. Rows with a null id come first; rows with equal ids
keep together, in any order. An empty table makes an empty file and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselink.llm.elias_fano import EliasFano
from caselink.llm.meeting import partitions
from caselink.llm.pieces import encoder_of
from caselink.llm.texts import slices

BLOCK_IDS = 1 << 20
BLOCKS = (
    "part int, block int, before bigint, n_ids bigint, width int, ids binary, doc_ids array<{kind}>, "
    "n_docs bigint, low_bits int, low binary, high binary"
)


def _writer(path: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = encoder_of(path)
        kind = np.dtype(f"<u{encoder.width}")
        if end_id >= 1 << (8 * encoder.width):
            raise ValueError("the end id does not fit the id width")
        before, block = 0, 0
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        docs: list[pa.Array] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal before, block, ids, counts, docs, size
            ends = np.cumsum(np.concatenate(counts))
            names = pa.chunked_array(docs).combine_chunks()
            index = EliasFano.encode(ends)
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([block], pa.int32()),
                    pa.array([before], pa.int64()),
                    pa.array([size], pa.int64()),
                    pa.array([encoder.width], pa.int32()),
                    pa.array([np.concatenate(ids).astype(kind).tobytes()], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
                    pa.array([len(names)], pa.int64()),
                    pa.array([index.low_bits], pa.int32()),
                    pa.array([index.low.tobytes()], pa.binary()),
                    pa.array([index.high.tobytes()], pa.binary()),
                ],
                names=["part", "block", "before", "n_ids", "width", "ids", "doc_ids", "n_docs", "low_bits", "low", "high"],
            )
            before, block = before + size, block + 1
            ids, counts, docs, size = [], [], [], 0
            return row

        for batch in batches:
            for slice_ in slices(batch.column(1)):
                flat, count = encoder.encode(slice_)
                ends = np.cumsum(count)
                closed = np.insert(flat, ends, end_id)
                ids.append(closed)
                counts.append(count + 1)
                docs.append(batch.column(0).slice(int(slice_.rows[0]), len(slice_.rows)))
                size += len(closed)
                if size >= block_ids:
                    yield flush()
        if counts:
            yield flush()

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 2,
    block_ids: int = BLOCK_IDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Write the token file of ``docs`` to the folder ``path``, replacing what is there.

    ``tokenizer`` is the path of a byte-level tokenizers file that every executor can open.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    ordered = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .repartitionByRange(partitions(docs), "id")
        .sortWithinPartitions("id")
    )
    blocks = ordered.mapInArrow(_writer(tokenizer, end_id, block_ids), BLOCKS.format(kind=kind))
    blocks.write.mode("overwrite").option("compression", "zstd").parquet(path)


def blocks_of(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a file with ``start``, the number of ids before each."""
    table = spark.read.parquet(path)
    totals = table.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    starts, at = [], 0
    for row in totals:
        starts.append((row.part, at))
        at += row.n
    bases = spark.createDataFrame(starts, "part int, base bigint")
    return table.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("before"))


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            start, width, ids, n, low_bits, low, high = (batch.column(k)[i].as_py() for k in range(1, 8))
            ends = EliasFano(n, low_bits, low, high).all()
            flat = np.frombuffer(ids, f"<u{width}").astype("<u4")
            begin = np.concatenate([[0], ends[:-1]])
            raw = memoryview(flat).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[i].values,
                    pa.array(begin + start),
                    pa.array(ends - begin),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document ``doc_id, start, n_tokens, ids_crc32``, from the file alone."""
    blocks = blocks_of(spark, path)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    return blocks.select("doc_ids", "start", "width", "ids", "n_docs", "low_bits", "low", "high").mapInArrow(
        _decode, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint"
    )
