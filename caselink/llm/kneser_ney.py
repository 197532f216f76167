"""Quality by perplexity: an interpolated modified Kneser-Ney model of character 5-grams per language.

Texts become symbols of one byte (Latin-1 as it is, digits alike, other scripts hashed to 32 symbols)
and are laid into packs of a few megabytes of one language, which are written once. Every pack sends
its distinct 5-grams, with their counts in trusted texts, to shards chosen by the two symbols before
the last. A shard then holds everything its 5-grams need down to order 3: contexts, continuation
counts and left extensions of the orders 5, 4 and 3 all share those two symbols. Orders 2 and 1 are a
dense table of 256 x 256 numbers per language, and discounts are four numbers per order, so both are
sent to all tasks. Shards join the counts to the 5-grams of the packs and return one log probability
for each; packs add them up by document. The packs' side of a shard grows with the corpus, so it is
dealt in blocks of bounded bytes. No step holds more than a pack, a block or a shard's counts.

The threshold of a language and length class is a quantile of the perplexities of trusted texts that
the model has not seen, chosen by how many rejected texts lie above it. A document above it is not kept. Empty and null texts have no perplexity and are not kept; texts of a language without
trusted text have none and are kept, since nothing is known about them; a null language is a language
of its own. Repeated rows count as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselink.llm.meeting import partitions, runs
from caselink.llm.texts import mix, slices
from caselink.session import savepoint

ORDER = 5
#: The quantile where too few texts are known to be rejected to choose one.
QUANTILE = 0.995
#: The quantiles to choose from: 0.5 to 10 % of unseen trusted texts are lost.
CHOICE = (0.9, 0.91, 0.92, 0.93, 0.94, 0.95, 0.96, 0.97, 0.98, 0.99, 0.995)
#: Trusted and rejected texts that a length class, or else a language, needs for limits of its own.
LEAST = 20
PACK_CHARS = 6 << 20
#: Compressed bytes of the packs' 5-grams of one shard that a task answers at once.
BLOCK = 64 << 20
_PAD = ORDER - 1

_SYMBOL = np.arange(256, dtype=np.uint8)
_SYMBOL[:32] = 32
_SYMBOL[10] = 10
_SYMBOL[127:160] = 32
_SYMBOL[48:58] = 48


def _press(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(np.ascontiguousarray(x).tobytes())


def _expand(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _symbols(part) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a slice and the number of them in each document."""
    begins = np.concatenate([[0], np.cumsum((part.buf & 0xC0) != 0x80)])
    points = np.frombuffer(part.buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    out = _SYMBOL[np.minimum(points, 255)]
    far = points > 255
    out[far] = 128 + (points[far] % 32)
    return out, np.diff(begins[part.offsets])


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows are sorted into packs by language. A pack is named by its task and its number there: the
    packs are written once, and packs of equal rows must not share a name."""
    from pyspark import TaskContext

    held: dict[str | None, list] = {}
    numbers = itertools.count(TaskContext.get().partitionId() << 32)

    def flush(lang: str | None) -> pa.RecordBatch:
        ids, sizes, symbols = zip(*held.pop(lang)[1])
        sizes, symbols = np.concatenate(sizes), np.concatenate(symbols)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([next(numbers)], pa.int64()),
                pa.array([lang], pa.string()),
                pa.array([pa.chunked_array(ids).to_pylist()], pa.list_(ids[0].type)),
                pa.array([sizes.astype(np.int32).tobytes()], pa.binary()),
                pa.array([_press(symbols)], pa.binary()),
            ],
            names=["pack", "lang", "doc_ids", "sizes", "symbols"],
        )

    for batch in batches:
        langs = np.array(batch.column(2).to_pylist(), object)
        for lang in dict.fromkeys(langs.tolist()):
            own = np.flatnonzero(np.array([x == lang for x in langs]))
            texts = batch.column(1).take(pa.array(own))
            ids = batch.column(0).take(pa.array(own))
            for part in slices(texts):
                symbols, sizes = _symbols(part)
                entry = held.setdefault(lang, [0, []])
                entry[0] += len(symbols)
                entry[1].append((ids.take(pa.array(part.rows)), sizes, symbols))
                if entry[0] >= PACK_CHARS:
                    yield flush(lang)
    for lang in list(held):
        yield flush(lang)


def _grams(sizes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The 5-gram that ends at every symbol, as 40 bits; zeros stand before a text."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(symbols)) + _PAD * (doc + 1)
    padded = np.zeros(len(symbols) + _PAD * len(sizes), np.uint64)
    padded[at] = symbols
    out = padded[at]
    for k in range(1, ORDER):
        out |= padded[at - k] << np.uint64(8 * k)
    return out


def _shard(grams: np.ndarray, n: int) -> np.ndarray:
    return (mix((grams >> np.uint64(8)) & np.uint64(0xFFFF)) % np.uint64(n)).astype(np.int64)


def _distinct(sizes: np.ndarray, symbols: np.ndarray, n_shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 5-grams ordered by shard and value, the place of each position's, and shard cuts."""
    code, values = pd.factorize(_grams(sizes, symbols))
    shard = _shard(values, n_shards)
    order = np.lexsort((values, shard))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return values[order], place[code], np.searchsorted(shard[order], np.arange(n_shards + 1))


def _send(n_shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pack, lang, sizes, symbols, trusted = (batch.column(k)[i].as_py() for k in range(5))
                sizes, symbols = np.frombuffer(sizes, np.int32), _expand(symbols, np.uint8)
                if not len(symbols):
                    continue
                values, place, cut = _distinct(sizes, symbols, n_shards)
                if trusted:
                    flags = np.unpackbits(np.frombuffer(trusted, np.uint8), count=len(sizes)).astype(bool)
                    counts = np.bincount(place[np.repeat(flags, sizes)], minlength=len(values))
                else:
                    counts = np.zeros(len(values), np.int64)
                used = np.flatnonzero(cut[1:] > cut[:-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used.astype(np.int32)),
                        pa.array(np.full(len(used), pack, np.int64)),
                        pa.array([lang] * len(used), pa.string()),
                        pa.array([_press(np.diff(values[cut[s] : cut[s + 1]], prepend=np.uint64(0))) for s in used], pa.binary()),
                        pa.array([_press(counts[cut[s] : cut[s + 1]].astype(np.uint32)) for s in used], pa.binary()),
                    ],
                    names=["shard", "pack", "lang", "grams", "counts"],
                )

    return run


def _values(grams: bytes) -> np.ndarray:
    return np.cumsum(_expand(grams, np.uint64), dtype=np.uint64)


def _types(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct suffixes of ``bits`` bits and the number of values that end in each."""
    return np.unique(values & np.uint64((1 << bits) - 1), return_counts=True)


class Table:
    """Counts of the n-grams of one order, with the totals of their contexts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.grams, self.counts = grams, counts.astype(np.float64)
        first = runs(grams >> np.uint64(8))
        self.contexts = (grams >> np.uint64(8))[first]
        add = lambda x: np.add.reduceat(x.astype(np.float64), first) if len(first) else np.zeros(0)
        self.totals = add(counts)
        self.kinds = [add(counts == 1), add(counts == 2), add(counts >= 3)]

    def probability(self, asked: np.ndarray, lower: np.ndarray, discounts: np.ndarray) -> np.ndarray:
        """Interpolated with ``lower``, which stands alone where the context is unknown."""
        if not len(self.grams):
            return lower

        def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return at, keys[at] == wanted

        at, known = find(self.contexts, asked >> np.uint64(8))
        spare = sum(d * k for d, k in zip(discounts, self.kinds))[at]
        own, seen = find(self.grams, asked)
        count = np.where(seen, self.counts[own], 0.0)
        cut = np.select([count == 0, count == 1, count == 2], [0.0, discounts[0], discounts[1]], discounts[2])
        total = self.totals[at]
        return np.where(known, (count - cut + spare * lower) / total, lower)


def _orders(grams: np.ndarray, counts: np.ndarray) -> dict[int, Table]:
    """Tables of the orders 5 to 3 of a shard: raw counts, then continuation counts."""
    tables = {ORDER: Table(grams, counts)}
    below = grams
    for order in range(ORDER - 1, 2, -1):
        below, spread = _types(below, 8 * order)
        tables[order] = Table(below, spread)
    return tables


def discounts_of(n: np.ndarray) -> np.ndarray:
    """The three modified Kneser-Ney discounts from the numbers of n-grams with counts 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2, n3, n4) <= 0:
        return np.array([0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = np.array([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, 0.01, [1.0, 2.0, 3.0])


def _statistics(rows: list[tuple[str | None, np.ndarray, np.ndarray]]) -> Iterator[tuple]:
    """``lang, kind, cell, n``: counts of counts by order (kind), and bigram continuations (kind 2)."""
    for lang, grams, counts in rows:
        tables = _orders(grams, counts)
        for order, table in tables.items():
            for c in range(1, 5):
                yield lang, order, c, int((table.counts == c).sum())
        pairs, spread = _types(tables[3].grams, 16)
        for pair, n in zip(pairs.tolist(), spread.tolist()):
            yield lang, 2, pair, n


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the trusted counts of the shards of a partition; give statistics and packed sums."""
    found: dict[tuple, list] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            shard, lang, grams, counts = (batch.column(k)[i].as_py() for k in range(4))
            values, n = _values(grams), _expand(counts, np.uint32)
            own = n > 0
            if own.any():
                entry = found.setdefault((shard, lang), [])
                entry.append((values[own], n[own].astype(np.int64)))
                if len(entry) > 8:
                    entry[:] = [_sum(entry)]
    for (shard, lang), entry in found.items():
        grams, counts = _sum(entry)
        stats = list(_statistics([(lang, grams, counts)]))
        _, kind, cell, n = zip(*stats)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([shard], pa.int32()),
                pa.array([lang], pa.string()),
                pa.array([_press(np.diff(grams, prepend=np.uint64(0)))], pa.binary()),
                pa.array([_press(counts)], pa.binary()),
                pa.array([np.array([kind, cell, n], np.int64).tobytes()], pa.binary()),
            ],
            names=["shard", "lang", "grams", "counts", "stats"],
        )


def _sum(entry: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, counts = (np.concatenate(x) for x in zip(*entry))
    values, code = np.unique(grams, return_inverse=True)
    return values, np.bincount(code, counts, len(values)).astype(np.int64)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, stats in zip(batch.column(0).to_pylist(), batch.column(1)):
            kind, cell, n = np.frombuffer(stats.as_py(), np.int64).reshape(3, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(n), pa.string()), pa.array(kind), pa.array(cell), pa.array(n)],
                names=["lang", "kind", "cell", "n"],
            )


class Lower:
    """What all shards share of a language: discounts, and orders 2 and 1 as a dense table."""

    def __init__(self, rows: list):
        counts = {order: np.zeros(4) for order in (5, 4, 3)}
        pairs = np.zeros((256, 256))
        for kind, cell, n in rows:
            if kind == 2:
                pairs[cell >> 8, cell & 255] = n
            else:
                counts[kind][cell - 1] = n
        self.discounts = {order: discounts_of(n) for order, n in counts.items()}
        single = (pairs > 0).sum(axis=0).astype(float)
        self.pairs = self._mixed(pairs, self._mixed(single[None, :], np.full((1, 256), 1 / 256)))

    @staticmethod
    def _mixed(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
        d = discounts_of(np.array([(counts == c).sum() for c in range(1, 5)]))
        cut = np.select([counts == 0, counts == 1, counts == 2], [0.0, d[0], d[1]], d[2])
        total = counts.sum(axis=1, keepdims=True)
        spare = cut.sum(axis=1, keepdims=True)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(total > 0, (counts - cut + spare * lower) / total, np.broadcast_to(lower, counts.shape))


def _answer(shared):
    """Log probabilities of the packs' 5-grams of a shard, from the shard's counts."""

    def run(key, packs: pa.Table, counts: pa.Table) -> pa.Table:
        lower: dict[str | None, Lower] = shared.value
        tables = {}
        for lang, grams, n in zip(counts["lang"].to_pylist(), counts["grams"].to_pylist(), counts["counts"].to_pylist()):
            tables[lang] = _orders(_values(grams), _expand(n, np.int64))
        pack, logs = [], []
        for name, lang, grams in zip(packs["pack"].to_pylist(), packs["lang"].to_pylist(), packs["grams"].to_pylist()):
            if lang not in lower:
                continue
            asked = _values(grams)
            low = lower[lang]
            p = low.pairs.ravel()[(asked & np.uint64(0xFFFF)).astype(np.int64)]
            for order in (3, 4, 5):
                if lang in tables:
                    part = asked & np.uint64((1 << (8 * order)) - 1)
                    p = tables[lang][order].probability(part, p, low.discounts[order])
            pack.append(name)
            logs.append(np.log(p).astype(np.float32).tobytes())
        return pa.table(
            {
                "pack": pa.array(pack, pa.int64()),
                "shard": pa.array([key[0].as_py()] * len(pack), pa.int32()),
                "logs": pa.array(logs, pa.binary()),
            }
        )

    return run


def _read(n_shards: int, kind: pa.DataType):
    def run(key, packs: pa.Table, answers: pa.Table) -> pa.Table:
        found = {s: x for s, x in zip(answers["shard"].to_pylist(), answers["logs"].to_pylist())}
        out = []
        for i in range(packs.num_rows):
            lang, ids, sizes, symbols = (packs[c][i].as_py() for c in ("lang", "doc_ids", "sizes", "symbols"))
            sizes, symbols = np.frombuffer(sizes, np.int32), _expand(symbols, np.uint8)
            perplexity = np.full(len(sizes), np.nan)
            if found and len(symbols):
                _, place, _ = _distinct(sizes, symbols, n_shards)
                logs = np.concatenate([np.frombuffer(found[s], np.float32) for s in sorted(found)])[place]
                some = sizes > 0
                begin = (np.cumsum(sizes) - sizes)[some]
                perplexity[some] = np.exp(-np.add.reduceat(logs.astype(np.float64), begin) / sizes[some])
            out.append(
                pa.table(
                    {
                        "doc_id": pa.array(ids, kind),
                        "lang": pa.array([lang] * len(sizes), pa.string()),
                        "n_chars": pa.array(sizes.astype(np.int64)),
                        "perplexity": pa.array(perplexity, from_pandas=True),
                        "place": pa.array(np.arange(len(sizes))),
                        "pack": pa.array(np.full(len(sizes), packs["pack"][i].as_py(), np.int64)),
                    }
                )
            )
        return pa.concat_tables(out) if out else _read_schema(kind).empty_table()

    return run


def _read_schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema(
        [("doc_id", kind), ("lang", pa.string()), ("n_chars", pa.int64()), ("perplexity", pa.float64()), ("place", pa.int64()), ("pack", pa.int64())]
    )


def _trust_bits(packs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``pack, trusted``: one bit per document of a pack that has any trusted one."""
    listed = packs.select("pack", F.posexplode("doc_ids").alias("place", "doc_id"))
    marked = listed.join(trusted.select("doc_id").distinct(), "doc_id").groupBy("pack").agg(F.collect_set("place").alias("places"))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for places in batch.column(1):
                at = places.values.to_numpy()
                row = np.zeros(int(at.max()) // 8 * 8 + 8, np.uint8)
                row[at] = 1
                cells.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary())], names=["pack", "trusted"])

    return savepoint(marked.mapInArrow(bits, "pack bigint, trusted binary"), "trusted_documents")


def _blocks(sent: DataFrame) -> DataFrame:
    """``shard, blocks``: into how many blocks of about ``BLOCK`` bytes the packs' n-grams of a shard are
    dealt. A shard of common symbols grows with the corpus, its trained counts with the alphabet only,
    so each block gets those counts whole. The table has a row per shard, so it is broadcast."""
    size = F.sum(F.length("grams"))
    blocks = sent.groupBy("shard").agg(F.ceil(size / F.lit(BLOCK)).cast("int").alias("blocks"))
    return F.broadcast(savepoint(blocks.select("shard", F.greatest(F.lit(1), "blocks").alias("blocks")), "shard_blocks"))


def perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``doc_id, lang, n_chars, perplexity, trusted`` per row of ``docs(doc_id, text, lang)``.

    ``trusted(doc_id)`` names the documents to learn from.
    """
    spark = docs.sparkSession
    n_shards = partitions(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    packs = savepoint(
        docs.select("doc_id", "text", F.col("lang").cast("string")).mapInArrow(
            _packs, f"pack bigint, lang string, doc_ids array<{kind}>, sizes binary, symbols binary"
        ),
        "packs",
    )
    bits = _trust_bits(packs, trusted)
    sent = savepoint(
        packs.join(bits, "pack", "left")
        .select("pack", "lang", "sizes", "symbols", "trusted")
        .mapInArrow(_send(n_shards), "shard int, pack bigint, lang string, grams binary, counts binary"),
        "pack_grams",
    )
    counts = savepoint(
        sent.select("shard", "lang", "grams", "counts")
        .repartition(partitions(docs), "shard")
        .mapInArrow(_train, "shard int, lang string, grams binary, counts binary, stats binary"),
        "shard_counts",
    )
    sums = (
        counts.select("lang", "stats")
        .mapInArrow(_add_up, "lang string, kind bigint, cell bigint, n bigint")
        .groupBy("lang", "kind", "cell")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    by_lang: dict[str | None, list] = {}
    for r in sums:
        by_lang.setdefault(r.lang, []).append((r.kind, r.cell, r.n))
    shared = spark.sparkContext.broadcast({lang: Lower(rows) for lang, rows in by_lang.items()})
    blocks = _blocks(sent)
    every_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    own_block = F.pmod(F.xxhash64("pack"), F.col("blocks")).cast("int").alias("block")
    answers = (
        sent.join(blocks, "shard")
        .select("shard", own_block, "pack", "lang", "grams")
        .groupBy("shard", "block")
        .cogroup(counts.join(blocks, "shard").select("shard", every_block, "lang", "grams", "counts").groupBy("shard", "block"))
        .applyInArrow(_answer(shared), "pack bigint, shard int, logs binary")
    )
    arrow_kind = pa.string() if kind == "string" else pa.int64() if kind == "bigint" else pa.int32()
    read = (
        packs.groupBy("pack")
        .cogroup(answers.groupBy("pack"))
        .applyInArrow(
            _read(n_shards, arrow_kind),
            f"doc_id {kind}, lang string, n_chars bigint, perplexity double, place bigint, pack bigint",
        )
    )
    return read


def _length_class(n_chars) -> Column:
    """Texts of up to 255 characters are one class; classes above end at powers of four."""
    return F.greatest(F.lit(3), F.floor(F.log2(F.greatest(n_chars, F.lit(1))) / 2)).cast("int")


def thresholds(known: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``lang, common, by_class`` from ``known(lang, n_chars, perplexity, aside, rejected)``.

    Of the quantiles of ``CHOICE``, taken over the trusted texts set aside, the one of the greatest
    sum of quantile and share of rejected texts above it; the largest of equals. A length class of
    fewer than ``LEAST`` rejected texts takes over its language's quantile, one of fewer than
    ``LEAST`` trusted ones its language's threshold too (``common``).
    """
    steps = [*CHOICE, quantile]
    both = known.select(
        "lang", F.explode(F.array(_length_class(F.col("n_chars")), F.lit(-1))).alias("class"), "perplexity", "aside", "rejected"
    )

    def limit(rows):
        return F.percentile_approx(F.when(rows & ~F.col("rejected"), F.col("perplexity")), steps, 100_000)

    limits = savepoint(
        both.groupBy("lang", "class").agg(
            F.coalesce(limit(F.col("aside")), limit(~F.col("aside"))).alias("limits"),
            F.count_if(F.col("aside") & ~F.col("rejected")).alias("n_clean"),
            F.count_if("rejected").alias("n_rejected"),
        ),
        "limits",
    )
    of = limits.select(F.col("lang").alias("of_lang"), F.col("class").alias("of_class"), "limits")
    above = (
        both.where("rejected")
        .join(of, F.col("lang").eqNullSafe(F.col("of_lang")) & (F.col("class") == F.col("of_class")))
        .groupBy("of_lang", "of_class")
        .agg(F.array(*[F.count_if(F.col("perplexity") > F.col("limits")[i]) for i in range(len(CHOICE))]).alias("above"))
    )
    gains = F.array(
        *[F.struct((F.lit(q) + F.col("above")[i] / F.col("n_rejected")).alias("gain"), F.lit(i).alias("at")) for i, q in enumerate(CHOICE)]
    )
    enough = (F.col("n_clean") >= LEAST) & (F.col("n_rejected") >= LEAST)
    chosen = limits.join(
        above, F.col("lang").eqNullSafe(F.col("of_lang")) & (F.col("class") == F.col("of_class")), "left"
    ).select("lang", "class", "limits", "n_clean", F.when(enough, F.array_max(gains)["at"]).alias("at"))
    rows = F.collect_list(F.struct("class", "limits", "n_clean", "at"))
    common = F.filter("rows", lambda r: r["class"] == -1)[0]
    at = F.coalesce(F.col("whole.at"), F.lit(len(CHOICE)))
    own = F.filter("rows", lambda r: (r["class"] >= 0) & (r["n_clean"] >= LEAST))
    return (
        chosen.groupBy("lang")
        .agg(rows.alias("rows"))
        .select("lang", "rows", common.alias("whole"))
        .select(
            "lang",
            F.get("whole.limits", at).alias("common"),
            F.map_from_entries(
                F.transform(own, lambda r: F.struct(r["class"], F.get(r["limits"], F.coalesce(r["at"], at))))
            ).alias("by_class"),
        )
    )


def judge(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, rejected: DataFrame | None = None) -> DataFrame:
    """``doc_id, lang, n_chars, perplexity, threshold, kept`` per row of ``docs``.

    A fifth of the trusted ids, by hash, is not learnt from and gives the quantiles, since texts that
    a model has seen are easier to it than others; a language without any in that fifth uses the
    trusted texts that it has. ``rejected(doc_id)`` names texts known to be bad, by which the
    quantiles are chosen; ids that are trusted too count as trusted. Without them it is ``quantile``.
    """
    fifth = trusted.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("aside"))
    learnt = fifth.where(~F.col("aside"))
    scored = savepoint(perplexities(docs, learnt).drop("place", "pack"), "perplexities")
    marks = fifth.withColumn("rejected", F.lit(False))
    if rejected is not None:
        marks = marks.unionByName(rejected.select("doc_id", F.lit(False).alias("aside"), F.lit(True).alias("rejected")))
    marks = marks.groupBy("doc_id").agg(F.max("aside").alias("aside"), F.min("rejected").alias("rejected"))
    known = savepoint(
        scored.where("perplexity IS NOT NULL").join(marks, "doc_id").select("lang", "n_chars", "perplexity", "aside", "rejected"),
        "labelled_perplexities",
    )
    limits = savepoint(thresholds(known, quantile), "thresholds").withColumnRenamed("lang", "of_lang")
    kept = (F.col("n_chars") > 0) & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    return (
        scored.join(limits, F.col("lang").eqNullSafe(F.col("of_lang")), "left")
        .withColumn("threshold", F.coalesce(F.try_element_at("by_class", _length_class(F.col("n_chars"))), "common"))
        .select("doc_id", "lang", "n_chars", "perplexity", "threshold", kept.alias("kept"))
    )
