"""Language identification by word-first backoff.

``identify`` learns from all words and n-grams of its training documents, and its counts stay on Spark
(``backoff_tables``): packs of documents send their distinct words to the word table, the n-grams of
unseen words go on to the tables of n-grams, and packs add up what comes back. ``train`` and ``predict`` do the same by a
model of bounded size that every task holds, which cuts the rare words and n-grams.

A model holds, for each language, the log frequencies of words, and of character n-grams of words
for n from ``LONGEST`` down to 1. A word of the model is scored by its word frequencies. An unseen
word is cut into n-grams of the greatest length of which the model knows one, and scored by their mean
log frequencies; if it knows none of a length, shorter ones are tried. Counts are summed over all
training documents; a model of ``train`` then keeps the commonest words and n-grams of each length, all of a frequency
class or none, as many classes as fit into ``WORDS`` and ``GRAMS``. That bounds what is sent to the
tasks. The rest are unseen words to it, which is what the backoff is for.

A document's language is the one of the greatest summed score; ``score`` is its posterior share for
equal priors, from 0 to 1. Ties go to the first language by name. A null text, or one without a letter,
is ``und`` with score 0, as is every text if there is nothing to learn from. Rows with a null id are
predicted like others and never learnt from. Repeated rows are learnt from and predicted as often as
they occur.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from caselink.llm import backoff_tables as tables
from caselink.llm.meeting import partitions
from caselink.session import savepoint

LONGEST = 5
WORDS = 100_000
GRAMS = 40_000
#: Words whose scores a task remembers.
CACHE = 200_000
FLUSH = 150_000
UNKNOWN = "und"

_LETTERS = regex.compile(r"\p{L}+")


def _tokens(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of a task by language, given out whenever there are many different words."""
    counts: dict[str, Counter] = {}

    def flush() -> pa.RecordBatch:
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        counts.clear()
        lang, word, n = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())],
            names=["lang", "word", "n"],
        )

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.setdefault(lang, Counter()).update(_tokens(text))
            if sum(map(len, counts.values())) >= FLUSH:
                yield flush()
    if any(counts.values()):
        yield flush()


def word_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, word, n`` over all rows that have both a language and a text."""
    return (
        docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
        .select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
        .mapInArrow(_count_words, "lang string, word string, n bigint")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
    )


class Model:
    """Score rows per language of words and n-grams; rows share one matrix."""

    def __init__(self, langs: list[str], words: dict[str, int], grams: list[dict[str, int]], scores: np.ndarray):
        self.langs, self.words, self.grams, self.scores = langs, words, grams, scores
        self.rows: list[tuple[float, ...]] = []

    def unseen(self, word: str) -> list[float]:
        if not self.rows:
            # Plain numbers: the sums are of a few rows, too short for array calls.
            self.rows = list(map(tuple, self.scores.tolist()))
        padded = f"\x02{word}\x03"
        length = len(padded)
        for n in range(min(LONGEST, length), 0, -1):
            get = self.grams[n - 1].get
            found = [r for r in [get(padded[i : i + n]) for i in range(length - n + 1)] if r is not None]
            if found:
                share = 1.0 / len(found)
                return [sum(column) * share for column in zip(*[self.rows[r] for r in found])]
        return [0.0] * len(self.langs)

    def word(self, word: str) -> np.ndarray | list[float]:
        row = self.words.get(word)
        return self.unseen(word) if row is None else self.scores[row]


def _commonest(table: DataFrame, unit: str, most: int, langs: list[str]) -> tuple[list[str], np.ndarray]:
    """The commonest units over all languages, and their counts by language.

    Units are classed by the logarithm of their count. The sizes of the classes, at most about a
    thousand numbers, tell which classes fit; no task or driver ranks more than it keeps.
    """
    wide = table.groupBy(unit).agg(
        F.sum("n").alias("total"),
        *[F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{i}") for i, lang in enumerate(langs)],
    )
    wide = savepoint(wide.withColumn("class", F.floor(F.log2("total") * 16).cast("int")), f"{unit}_counts")
    sizes = sorted(wide.groupBy("class").count().collect(), reverse=True)
    least, kept = None, 0
    for row in sizes:
        kept += row["count"]
        if kept > most:
            break
        least = row["class"]
    rows = wide.where(F.col("class") >= least).collect() if least is not None else []
    rows.sort(key=lambda r: (-r.total, r[unit]))
    counts = np.array([[r[f"n{i}"] for i in range(len(langs))] for r in rows], np.float64)
    return [r[unit] for r in rows], counts.reshape(len(rows), len(langs))


def _log_frequencies(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Logs of smoothed relative frequencies: half a count for what a language has not shown."""
    return np.log((counts + 0.5) / (totals + 0.5 * len(counts))).astype(np.float32)


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", words: int = WORDS, grams: int = GRAMS) -> Model:
    """Learn from all rows of ``docs``. At most ``words + LONGEST * grams`` rows reach the driver."""
    counted = savepoint(word_counts(docs, lang_col, text_col), "word_counts")
    sums = {r.lang: r.n for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(sums)
    if not langs:
        return Model([], {}, [{} for _ in range(LONGEST)], np.zeros((0, 0), np.float32))
    totals = np.array([float(sums[lang]) for lang in langs])
    units, counts = _commonest(counted, "word", words, langs)
    index, parts, at = {w: i for i, w in enumerate(units)}, [_log_frequencies(counts, totals)], len(units)
    by_length = []
    for n in range(1, LONGEST + 1):
        cut = counted.select("lang", "n", F.explode(_grams_of(n)).alias("gram"))
        table = cut.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        units, counts = _commonest(table, "gram", grams, langs)
        by_length.append({g: at + i for i, g in enumerate(units)})
        parts.append(_log_frequencies(counts, counts.sum(axis=0)))
        at += len(units)
    return Model(langs, index, by_length, np.concatenate(parts))


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        place: dict[str, int] = {}
        rows = np.zeros((1024, len(model.langs)), np.float32)
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(1).to_pylist():
                tokens = _tokens(text) if text else []
                if not tokens or not model.langs:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                if len(place) > CACHE:
                    place.clear()
                new = [w for w in dict.fromkeys(tokens) if w not in place]
                while len(place) + len(new) > len(rows):
                    rows = np.concatenate([rows, np.zeros_like(rows)])
                for w in new:
                    at = place[w] = len(place)
                    rows[at] = model.word(w)
                at = np.fromiter(map(place.__getitem__, tokens), np.int64, len(tokens))
                total = rows[at].sum(axis=0, dtype=np.float64)
                best = int(total.argmax())
                langs.append(model.langs[best])
                scores.append(float(1.0 / np.exp(np.maximum(total - total[best], -700.0)).sum()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in [0]), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["row", "lang_pred", "score"],
            )

    return run


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``row, lang_pred, score``; ``row`` holds all columns of ``docs`` but the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    boxed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"), F.col(text_col).alias("text")
    )
    row = boxed.schema["row"].dataType.simpleString()
    return boxed.mapInArrow(_predict(shared), f"row {row}, lang_pred string, score double")


def _grams_of(n: int):
    """The n-grams of ``word`` between its two end marks."""
    padded = F.concat(F.lit("\x02"), "word", F.lit("\x03"))
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(padded) - (n - 1), F.lit(1)))
    cut = F.transform(starts, lambda i: F.substring(padded, i, F.lit(n)))
    return F.when(F.char_length(padded) >= n, cut)


def _as_read(docs: DataFrame) -> bool:
    """Whether rows come as files hold them, so that reading them again gives the same tasks."""
    plan = docs._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return all(line.lstrip("+-: ").split(" ")[0] in ("Project", "Filter", "Relation") for line in plan if line.strip())


def _add_up(scale: tables.Scale, schema: pa.Schema):
    langs = scale.langs

    def run(key, packs: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for i in range(packs.num_rows):
            rows = packs["rows"][i].values
            sizes = np.frombuffer(packs["sizes"][i].as_py(), np.int32)
            best, share = [UNKNOWN] * len(sizes), np.zeros(len(sizes))
            if langs:
                scores = tables.word_scores(scale, packs["words"][i].as_py(), answers.to_pylist())
                places = tables.unpress(packs["places"][i].as_py(), np.int32)
                ends = np.cumsum(sizes, dtype=np.int64)
                for d in np.flatnonzero(sizes):
                    total = scores[places[ends[d] - sizes[d] : ends[d]]].sum(axis=0, dtype=np.float64)
                    k = int(total.argmax())
                    best[d], share[d] = langs[k], 1.0 / np.exp(np.maximum(total - total[k], -700.0)).sum()
            out.append(pa.table([rows, pa.array(best, pa.string()), pa.array(share)], names=["row", "lang_pred", "score"]))
        return pa.concat_tables(out).cast(schema) if out else schema.empty_table()

    return run


def identify(learnt: DataFrame, docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``row, lang_pred, score`` of ``docs`` by all words and n-grams of ``learnt``; see ``predict``.

    Documents are read twice, once to ask for the scores of their words and once to add them up; rows
    that do not come straight from files are written first.
    """
    buckets = max(1, partitions(docs) // 4)
    known = learnt.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counted = known.select(F.col(lang_col).cast("string"), text_col).mapInArrow(tables.learn(buckets), tables.LEARNT)
    parts = savepoint(counted.repartitionById(buckets, "bucket").mapInArrow(tables.tabulate(buckets), tables.TABLE), "word_tables")
    words = parts.where("kind = 0")
    grams = savepoint(
        parts.where("kind > 0").repartitionById(buckets, "bucket").mapInArrow(tables.merge_grams, tables.TABLE), "gram_tables"
    )
    sums = words.unionByName(grams).groupBy("kind", "lang").agg(F.sum("total").alias("total"), F.sum("units").alias("units")).collect()
    langs = sorted({r.lang for r in sums})
    totals = {r.kind: [0] * len(langs) for r in sums}
    units = dict.fromkeys(totals, 0)
    for r in sums:  # a row for each language and length
        totals[r.kind][langs.index(r.lang)] = r.total
        units[r.kind] += r.units
    scale = tables.Scale(langs, totals, units)

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    boxed = docs.select(row.alias("row"), F.col(text_col).alias("text"))
    if not _as_read(docs):
        boxed = savepoint(boxed, "documents")
    kind = boxed.schema["row"].dataType
    asked = boxed.mapInArrow(tables.ask(buckets), tables.ASKED)
    answers = savepoint(
        asked.groupBy("bucket").cogroup(words.groupBy("bucket")).applyInArrow(tables.answer_words(langs), tables.ANSWER), "word_answers"
    )
    sent = answers.where(f"kind = {tables.UNSEEN}").groupBy("pack").applyInArrow(tables.ask_grams(buckets), tables.ANSWER)
    backed = sent.groupBy("bucket").cogroup(grams.groupBy("bucket")).applyInArrow(tables.answer_grams(langs), tables.ANSWER)
    whole = answers.unionByName(backed).withColumnRenamed("pack", "of_pack")
    packs = boxed.mapInArrow(
        tables.pack, f"pack bigint, rows array<{kind.simpleString()}>, sizes binary, places binary, words bigint"
    )
    # As the declared type has it: all fields may be null.
    nullable = to_arrow_type(DataType.fromDDL(kind.simpleString()))
    schema = pa.schema([("row", nullable), ("lang_pred", pa.string()), ("score", pa.float64())])
    return (
        packs.groupBy("pack")
        .cogroup(whole.groupBy("of_pack"))
        .applyInArrow(_add_up(scale, schema), f"row {kind.simpleString()}, lang_pred string, score double")
    )
