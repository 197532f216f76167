"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Every word n-gram of the test items is a seed, rare if few items hold it; the others seed only items
that have too few rare ones. Tasks test the n-grams of all documents against a Bloom filter of the
seeds, whose size is a constant, and note the passages that hold a hit. The hits count the seeds in the
documents. Where a copy must hold so many of an item's seeds that the commonest of them can be left
out, they are; a document is a candidate for an item if it holds one of the seeds left, and two of all
where the item has more than ``SHORT`` words. Only then are the words of candidate passages cut out,
and scored by local alignment, so that inserted, dropped and replaced words cost a little and do not
hide a copy.

Items of more than ``ITEM_WORDS`` words are cut into parts, each of which counts like an item of its
own, so that an alignment never grows with the length of an item. A document is contaminated by an item if the best local alignment reaches ``SHARE`` of the item's
perfect score, and is not by mere chance (``LEAST`` words' worth, or all of a shorter item). Words
are runs of letters, digits and non-ASCII bytes, lower-cased. Null or wordless texts and items match
nothing; items of fewer than ``SEED`` words hold no seed and match nothing; repeated rows and items
give repeated results; an empty table on either side gives no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselink.llm.meeting import runs, with_key
from caselink.llm.texts import Rolling, Slice, longs, slices, word_spans
from caselink.session import savepoint

SEED = 3
#: Bits of the Bloom filter: two megabytes, whatever the number of seeds.
BLOOM_BITS = 1 << 24
MATCH, MISMATCH, GAP = 2, -1, -1
SHARE = 0.4
LEAST = 7
#: A seed is rare in this many items at most; an item needs this many rare seeds to do without others.
RARE_ITEMS, RARE_SEEDS = 2, 8
STRIDE = 192
#: Longer items are matched by parts of about this many words.
ITEM_WORDS = 512
#: Items of so many words or fewer ask for one seed, longer ones for two.
SHORT = 8
#: So many documents with candidates are joined by broadcast, more by shuffle.
BROADCAST_ROWS = 200_000
ROOM = 1 << 21

_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _words(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of normalised words, and each document's first word. Capitals of the Latin-1 letters
    are two bytes whose second differs from the small letter's by 32."""
    buf = _LOWER[part.buf]
    capital = np.zeros(len(buf), bool)
    capital[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
    buf[capital] += 32
    starts, ends, first = word_spans(Slice(part.rows, buf, part.offsets), _APART)
    return Rolling(buf)(starts, ends), first


def _short(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(32)).astype(np.uint32)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        item, part_no, n_words, words32, seeds = [], [], [], [], []
        keys = batch.column(0).to_pylist()
        for part in slices(batch.column(1)):
            words, first = _words(part)
            grams = Rolling(words)
            for row, begin, end in zip(part.rows, first[:-1], first[1:]):
                cuts = np.linspace(begin, end, 1 + max(1, round((end - begin) / ITEM_WORDS))).astype(np.int64)
                for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
                    item.append(keys[row])
                    part_no.append(k)
                    n_words.append(hi - lo)
                    words32.append(_short(words[lo:hi]).tobytes())
                    at = np.arange(lo, max(lo, hi - SEED + 1))
                    seeds.append(np.unique(grams(at, at + SEED)).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(item, pa.int64()),
                pa.array(part_no, pa.int32()),
                pa.array(n_words, pa.int64()),
                pa.array(words32, pa.binary()),
                pa.array(seeds, pa.list_(pa.int64())),
            ],
            names=["item", "part", "n_words", "item_words", "seeds"],
        )


def seed_table(items: DataFrame) -> DataFrame:
    """``seed, item, part, n_words``: rare seeds of every item, and all seeds of items with few rare ones."""
    pairs = items.select("item", "part", "n_words", F.explode("seeds").alias("seed"))
    spread = pairs.groupBy("seed").agg(F.count("*").alias("n_items"))
    by_item = Window.partitionBy("item", "part")
    ranked = pairs.join(spread, "seed").withColumn(
        "rare", F.sum((F.col("n_items") <= RARE_ITEMS).cast("int")).over(by_item)
    )
    return ranked.where((F.col("n_items") <= RARE_ITEMS) | (F.col("rare") < RARE_SEEDS)).select(
        "seed", "item", "part", "n_words"
    )


def leading_seeds(seeds: DataFrame, hits: DataFrame, share: float) -> DataFrame:
    """``seeds`` with ``leads``: whether a document that holds this seed is looked at for the item.

    A copy may miss the perfect score by some points. An inserted word costs one point and breaks two
    seeds at most, every other edit costs more for each seed that it breaks; so a copy holds all but
    twice so many of the item's seeds, and one of those that are left when so many less one of the
    commonest are taken away.
    """
    counted = hits.groupBy("seed").agg(F.count("*").alias("n_hits"))
    by_item = Window.partitionBy("item", "part")
    least = F.greatest(F.col("n_words") * share, F.least(F.col("n_words"), F.lit(LEAST))) * MATCH
    broken = 2 * F.floor(F.col("n_words") * MATCH - least)
    held = F.greatest(F.lit(1), F.count("*").over(by_item) - broken)
    rank = F.row_number().over(by_item.orderBy(F.coalesce("n_hits", F.lit(0)), "seed"))
    return seeds.join(counted, "seed", "left").select(
        "seed", "item", "part", "n_words", (rank <= F.count("*").over(by_item) - held + 1).alias("leads")
    )


def _bloom(seeds: DataFrame) -> np.ndarray:
    """The filter as bytes: at most 2**18 rows of 64 bits reach the driver."""
    bit = F.explode(F.array(*_places(F.col("seed"))))
    words = (
        seeds.select(bit.alias("bit"))
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
        .collect()
    )
    table = np.zeros(BLOOM_BITS // 64, np.uint64)
    for row in words:
        table[row.word] = np.uint64(row.bits & 0xFFFFFFFFFFFFFFFF)
    return table


def _places(seed):
    """Two bit positions of a seed: its low and its next 24 bits."""
    mask = F.lit(BLOOM_BITS - 1).cast("bigint")
    return [seed.bitwiseAND(mask), F.shiftrightunsigned(seed, 24).bitwiseAND(mask)]


def _hit(table: np.ndarray, seed: np.ndarray) -> np.ndarray:
    found = np.ones(len(seed), bool)
    for shift in (0, 24):
        place = (seed >> np.uint64(shift)) & np.uint64(BLOOM_BITS - 1)
        found &= ((table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)) == 1
    return found


def _hits(bloom):
    """``key, place, seed``: the seeds that the filter knows in each stretch of ``STRIDE`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bloom.value
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for part in slices(batch.column(1)):
                words, first = _words(part)
                doc = np.repeat(np.arange(len(part.rows)), np.diff(first))
                seed = Rolling(words).windows(SEED)
                if not len(seed):
                    continue
                at = np.flatnonzero((doc[: len(seed)] == doc[SEED - 1 :]) & _hit(table, seed))
                place = (at - first[doc[at]]) // STRIDE
                order = np.lexsort((seed[at], place, doc[at]))
                doc_, place, seed_ = doc[at][order], place[order], seed[at][order]
                lead = runs(doc_, place, seed_)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[part.rows[doc_[lead]]]), pa.array(place[lead]), longs(seed_[lead])],
                    names=["key", "place", "seed"],
                )

    return run


def _cut(room: int):
    """The words of given stretches of documents, and ``room`` words to either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for part in slices(batch.column(1)):
                words, first = _words(part)
                short = _short(words)
                out: list[list] = [[], [], [], []]
                for row, begin, end in zip(part.rows.tolist(), first[:-1].tolist(), first[1:].tolist()):
                    for place in places[row]:
                        start = begin + place * STRIDE
                        lo, hi = max(begin, start - room), min(end, start + STRIDE + room)
                        out[0].append(keys[row])
                        out[1].append(place)
                        out[2].append(lo - begin)
                        out[3].append(short[lo:hi].tobytes())
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, kind) for x, kind in zip(out, kinds)], names=["key", "place", "from_word", "words"]
                )

    return run


def alignment_scores(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each (item, passage) pair of word hashes.

    Rows of the item are taken one by one for all pairs at once; a gap along the passage is a running
    maximum, since every further word costs the same.
    """
    pairs = len(items)
    m, n = max(map(len, items)), max(map(len, passages))
    a = np.zeros((pairs, m), np.int64) - 1
    b = np.zeros((pairs, n), np.int64) - 2
    for i, (x, y) in enumerate(zip(items, passages)):
        a[i, : len(x)] = x
        b[i, : len(y)] = y
    slope = -GAP * np.arange(n, dtype=np.int32)
    above = np.zeros((pairs, n + 1), np.int32)
    best = np.zeros(pairs, np.int32)
    for j in range(m):
        step = np.where(a[:, j : j + 1] == b, MATCH, MISMATCH).astype(np.int32)
        row = np.maximum(np.maximum(above[:, :-1] + step, above[:, 1:] + GAP), 0)
        row = np.maximum.accumulate(row + slope, axis=1) - slope
        above[:, 1:] = row
        np.maximum(best, row.max(axis=1), out=best)
    return best


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items = [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(3)]
        texts = [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(4)]
        scores = np.zeros(len(items), np.int64)
        order = sorted(range(len(items)), key=lambda i: len(items[i]))
        at = 0
        while at < len(order):
            width = max(len(texts[i]) for i in order[at : at + 256])
            to = at + max(1, min(256, ROOM // max(1, width)))
            now = order[at:to]
            scores[now] = alignment_scores([items[i] for i in now], [texts[i] for i in now])
            at = to
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(3)), pa.array(scores), pa.array([len(x) for x in items], pa.int64())],
            names=["key", "place", "item", "score", "item_words"],
        )


def contaminations(
    docs: DataFrame,
    benchmark: DataFrame,
    share: float = SHARE,
    id_col: str = "doc_id",
    item_col: str = "item_id",
    text_col: str = "text",
) -> DataFrame:
    """``key, doc_id, item_id, score, share, place``: each contaminated row with each of its items.

    ``place`` is the first word of the passage that aligns best. ``share`` is the score over the
    item's perfect score.
    """
    items = savepoint(
        with_key(benchmark.select(item_col, text_col), item_col, text_col)
        .select("key", "text")
        .mapInArrow(_items, "item bigint, part int, n_words bigint, item_words binary, seeds array<bigint>"),
        "items",
    )
    seeds = savepoint(seed_table(items), "seeds")
    longest = items.agg(F.max(F.length("item_words"))).first()[0] or 0
    bloom = docs.sparkSession.sparkContext.broadcast(_bloom(seeds))
    keyed = with_key(docs.select(id_col, text_col), id_col, text_col)
    hits = savepoint(
        keyed.select("key", "text").mapInArrow(_hits(bloom), "key bigint, place bigint, seed bigint").distinct(), "hits"
    )
    led = savepoint(leading_seeds(seeds, hits, share), "leading_seeds")
    met = hits.join(led.where("leads"), "seed").groupBy("key", "item", "part").agg(
        F.countDistinct("seed").alias("n"), F.max("n_words").alias("n_words"), F.collect_set("place").alias("places")
    )
    # Of items of more words than SHORT all seeds lead, so that two can be asked for.
    kept = met.where((F.col("n") >= 2) | (F.col("n_words") <= SHORT))
    pairs = savepoint(kept.select("key", "item", "part", F.explode("places").alias("place")), "candidates")
    wanted = savepoint(pairs.groupBy("key").agg(F.collect_set("place").alias("places")), "wanted_passages")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    cut = keyed.join(wanted, "key").select("key", "text", "places").mapInArrow(
        _cut((longest // 4) * 5 // 4 + SEED), "key bigint, place bigint, from_word bigint, words binary"
    )
    cut = savepoint(cut.dropDuplicates(["key", "place"]), "passages")
    aligned = (
        pairs.join(cut, ["key", "place"])
        .join(items.select("item", "part", "item_words").dropDuplicates(["item", "part"]), ["item", "part"])
        .select("key", F.col("from_word").alias("place"), "item", "item_words", "words")
        .mapInArrow(_align, "key bigint, place bigint, item bigint, score bigint, item_words bigint")
    )
    perfect = F.col("item_words") * MATCH
    enough = (F.col("score") >= perfect * share) & (
        F.col("score") >= F.least(perfect, F.lit(LEAST * MATCH))
    )
    best = (
        aligned.where(enough)
        .groupBy("key", "item")
        .agg(F.max(F.struct("score", (-F.col("place")).alias("back"), "item_words")).alias("best"))
    )
    names = savepoint(keyed.select("key", F.col(f"row.{id_col}").alias("doc_id")), "document_keys")
    item_names = with_key(benchmark.select(item_col, text_col), item_col, text_col).select(
        F.col("key").alias("item"), F.col(f"row.{item_col}").alias("item_id")
    )
    return (
        savepoint(best, "contaminated")
        .join(names, "key")
        .join(savepoint(item_names, "item_keys"), "item")
        .select(
            "key",
            "doc_id",
            "item_id",
            F.col("best.score").alias("score"),
            (F.col("best.score") / (F.col("best.item_words") * MATCH)).alias("share"),
            (-F.col("best.back")).alias("place"),
        )
    )


def clean_rows(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` that hold no passage of a test item, whole."""
    dirty = contaminations(docs, benchmark, share).select(F.col("key").alias("dirty")).distinct()
    keyed = with_key(docs)
    clean = keyed.join(savepoint(dirty, "dirty_keys"), F.col("key") == F.col("dirty"), "left_anti")
    return clean.select(F.struct("text").alias("t"), "row").select(
        *[F.col("t.text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    )
