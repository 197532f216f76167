"""Which sources of a language use which terms, and how far sources lie apart: late string materialisation.

Terms are runs of letters (ASCII letters in lower case, and every character beyond ASCII). Tasks count
them as 64-bit digests; digests, counts and group numbers are all that the counting shuffles move.
Strings are moved once: each task sends a digest's string to the dictionary, whose minimum and maximum
per digest show whether two terms share it. The terms of such a digest are split, that is, counted by
digest and string. Strings are joined back for the rows that are reported.

Shares are whole numbers, ``1 + floor(10^9 * (count + 1) / (N + V))`` for a term in a group of N kept
occurrences, V kept terms in the language; a divergence is ``floor((p - q)^2 / q)``. All of it is exact.

Two sources are compared over all kept terms, most of which neither has. With zero counts as the
ground level, the sum is that level, what each source's own terms add to it (from a histogram of their
shares), and what terms of both add; only the last looks at pairs, in arrays, and sends one sum for
each pair of sources and chunk.

Null text, language and source are empty strings. Repeated rows count as often as they occur. A group
without terms is compared all the same. An empty table has no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caselink.llm.meeting import partitions, runs
from caselink.llm.texts import Rolling, Slice, longs, slices, word_spans
from caselink.session import savepoint

LEAST_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
HELD = 1_000_000
PAIRS = 2_000_000

_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


class _Counts:
    """Occurrences and documents of each (group, term) of a task, with the terms' strings."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.groups: dict[tuple, int] = {}
        self.held: list[tuple[np.ndarray, ...]] = []
        self.strings: list[pa.Array] = []
        self.size = 0

    def add(self, part: Slice, lang: list[str], source: list[str]) -> None:
        part = Slice(part.rows, _LOWER[part.buf], part.offsets)
        starts, ends, first = word_spans(part, _OUTSIDE)
        if not len(starts):
            return
        one, two = (Rolling(part.buf, k)(starts, ends) for k in (0, 1))
        code, _ = pd.factorize(one)
        lead = np.zeros(code.max() + 1, np.int64)
        lead[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        if not np.array_equal(two, two[lead[code]]):
            both = np.rec.fromarrays([one, two])
            _, lead, code = np.unique(both, return_index=True, return_inverse=True)
        terms = len(lead)
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(lang, source)], np.int64)
        doc = np.repeat(np.arange(len(group)), np.diff(first))
        seen, often = np.unique(doc * terms + code, return_counts=True)
        doc, term = np.divmod(seen, terms)
        key = group[doc] * terms + term
        order = np.argsort(key, kind="stable")
        lead_of = runs(key[order])
        n, docs = np.add.reduceat(often[order], lead_of), np.diff(np.r_[lead_of, len(order)])
        group_of, term = np.divmod(key[order][lead_of], terms)
        # All words without what lies between them, so that Arrow can take strings from it.
        letters = part.buf[~_OUTSIDE[part.buf]]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters))
        self.held.append((group_of, one[lead][term], two[lead][term], n, docs))
        self.strings.append(words.take(pa.array(lead[term])))
        self.size += len(term)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        group, one, two, n, docs = (np.concatenate(x) for x in zip(*self.held))
        strings = pa.concat_arrays(self.strings)
        names = [*self.groups]
        self.held, self.strings, self.size = [], [], 0
        order = np.lexsort((two, one, group))
        lead = runs(group[order], one[order], two[order])
        n, docs = np.add.reduceat(n[order], lead), np.add.reduceat(docs[order], lead)
        kept = order[lead]
        of = pa.array(group[kept])
        lang, source = (pa.array([g[k] for g in names], pa.string()).take(of) for k in (0, 1))
        yield pa.RecordBatch.from_arrays(
            [lang, source, longs(one[kept] >> self.shift), strings.take(pa.array(kept)).cast(pa.string()), pa.array(n), pa.array(docs)],
            names=["lang", "source", "digest", "term", "n", "docs"],
        )


def _counter(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(bits)
        for batch in batches:
            lang, source = (batch.column(k).to_pylist() for k in (0, 1))
            for part in slices(batch.column(2)):
                rows = slice(int(part.rows[0]), int(part.rows[-1]) + 1)
                counts.add(part, lang[rows], source[rows])
                if counts.size >= HELD:
                    yield from counts.flush()
        yield from counts.flush()

    return run


def share(count: Column, total: Column) -> Column:
    """``floor(10^9 * count / total)`` for ``count <= total``, by long division in steps of a thousand."""
    quotient, left = F.lit(0).cast("bigint"), count.cast("bigint")
    for _ in range(3):
        quotient = quotient * 1000 + F.call_function("div", left * 1000, total)
        left = (left * 1000) % total
    return quotient


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What terms that two sources share add to their divergence, above the ground level and what each
    adds by itself; one row per chunk and ordered pair of sources. Terms come sorted."""
    held: list[pa.RecordBatch] = []

    def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        lang, digest, gid, p, zero = (rows.column(k).to_numpy() for k in (0, 1, 3, 4, 5))
        split = rows.column(2).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        first = runs(lang, digest, split)
        size = np.diff(np.r_[first, len(lang)])
        start, many = np.repeat(first, size), np.repeat(size, size)
        up_to = np.cumsum(many)
        at = 0
        while at < len(lang):
            to = max(at + 1, int(np.searchsorted(up_to, (up_to[at - 1] if at else 0) + PAIRS, "right")))
            mine = np.repeat(np.arange(at, to), many[at:to])
            ends = np.cumsum(many[at:to])
            other = np.arange(len(mine)) - np.repeat(ends - many[at:to], many[at:to]) + start[mine]
            apart = mine != other
            mine, other = mine[apart], other[apart]
            at = to
            if not len(mine):
                continue

            def far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                return (a - b) ** 2 // b

            a, a0, b, b0 = p[mine], zero[mine], p[other], zero[other]
            added = far(a, b) - far(a, b0) - far(a0, b) + far(a0, b0)
            names, code = np.unique(np.concatenate([gid[mine], gid[other]]), return_inverse=True)
            pair = code[: len(mine)] * len(names) + code[len(mine) :]
            order = np.argsort(pair, kind="stable")
            lead = runs(pair[order])
            x, y = np.divmod(pair[order][lead], len(names))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[x]), pa.array(names[y]), pa.array(np.add.reduceat(added[order], lead))],
                names=["gid", "other", "value"],
            )

    for batch in batches:
        if not batch.num_rows:
            continue
        # Rows up to the last change of term are whole.
        lang, digest = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        change = np.flatnonzero((lang[1:] != lang[:-1]) | (digest[1:] != digest[:-1]))
        if len(change):
            cut = int(change[-1]) + 1
            yield from settle(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield from settle(pa.Table.from_batches(held))


def audit(
    docs: DataFrame,
    least_docs: int = LEAST_DOCS,
    top: int = TOP,
    bits: int = 64,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """``lang, source, part, item, value, rank``: per source the divergence from each other source of its
    language (part ``pair``) and the ``top`` terms that it uses more than its language does (``term``).

    Ranks are by falling value, then item. ``bits`` is the width of the digests.
    """

    def text_of(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    base = docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source"), F.col(text_col).alias("text"))
    schema = "lang string, source string, digest bigint, term string, n bigint, docs bigint"
    parts = savepoint(base.mapInArrow(_counter(bits), schema), "term_parts")
    spread = base.select("lang", "source").distinct().withColumn("gid", F.monotonically_increasing_id())
    groups = savepoint(spread, "groups")
    langs = groups.groupBy("lang").agg(F.min("gid").alias("lid"))
    groups = savepoint(groups.join(langs, "lang"), "numbered_groups")

    words = savepoint(
        parts.groupBy("digest").agg(F.min("term").alias("term"), F.max("term").alias("last")), "dictionary"
    )
    shared = savepoint(words.where("term <> last").select("digest"), "shared_digests").withColumn("shared", F.lit(True))
    numbered = parts.join(groups, ["lang", "source"]).join(shared, "digest", "left")
    key = ["lid", "digest", "split"]
    counts = (
        numbered.select("gid", "lid", "digest", F.when(F.col("shared"), F.col("term")).alias("split"), "n", "docs")
        .groupBy("gid", *key)
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    counts = savepoint(counts, "term_counts")
    kept = counts.groupBy(*key).agg(F.sum("docs").alias("in_docs"), F.sum("n").alias("all_n")).where(F.col("in_docs") >= least_docs)
    kept = savepoint(kept.select(*[F.col(c).alias(f"_{c}") for c in key], "all_n"), "kept_terms")
    same = (F.col("lid") == F.col("_lid")) & (F.col("digest") == F.col("_digest")) & F.col("split").eqNullSafe(F.col("_split"))
    found = savepoint(counts.join(kept, same).select("gid", *key, "n", "all_n"), "kept_counts")

    of_lang = kept.groupBy(F.col("_lid").alias("lid")).agg(F.count("*").alias("terms"), F.sum("all_n").alias("lang_n"))
    of_group = found.groupBy("gid").agg(F.sum("n").alias("group_n"))
    sized = (
        groups.join(of_lang, "lid", "left")
        .join(of_group, "gid", "left")
        .fillna(0, ["terms", "lang_n", "group_n"])
        .withColumn("zero", 1 + share(F.lit(1), F.greatest(F.lit(1), F.col("group_n") + F.col("terms"))))
    )
    sized = savepoint(sized, "sized_groups")
    scored = found.join(sized.select("gid", "source", "lang", "group_n", "lang_n", "terms", "zero"), "gid").withColumns(
        {
            "p": 1 + share(F.col("n") + 1, F.col("group_n") + F.col("terms")),
            "q": 1 + share(F.col("all_n") + 1, F.col("lang_n") + F.col("terms")),
        }
    )

    high = scored.where("p > q").withColumn("value", gap(F.col("p"), F.col("q")))
    by_value = Window.partitionBy("gid").orderBy(F.desc("value"))
    high = high.withColumn("place", F.rank().over(by_value)).where(F.col("place") <= top)
    named = high.select("gid", "lang", "source", "digest", "split", "value").join(words.select("digest", "term"), "digest")
    named = named.select("gid", "lang", "source", F.coalesce("split", "term").alias("item"), "value")
    ranked = Window.partitionBy("gid").orderBy(F.desc("value"), "item")
    terms = named.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    mine = sized.select("gid", "lid", "lang", "source", "zero", "terms")
    theirs = sized.select(F.col("gid").alias("other"), "lid", F.col("source").alias("item"), F.col("zero").alias("other_zero"))
    couples = mine.join(theirs, "lid").where("gid <> other")
    ground = gap(F.col("zero"), F.col("other_zero"))
    levels = scored.groupBy("gid", "p").agg(F.count("*").alias("m"))
    own = couples.join(levels, "gid").select(
        "gid", "other", (F.col("m") * (gap(F.col("p"), F.col("other_zero")) - ground)).alias("value")
    )
    their = couples.join(levels.withColumnRenamed("gid", "other"), "other").select(
        "gid", "other", (F.col("m") * (gap(F.col("zero"), F.col("p")) - ground)).alias("value")
    )
    both = (
        scored.select("lid", "digest", "split", "gid", "p", "zero")
        .repartition(partitions(docs), *key)
        .sortWithinPartitions(*key)
        .mapInArrow(_overlaps, "gid bigint, other bigint, value bigint")
    )
    level = couples.select("gid", "other", (F.col("terms") * ground).alias("value"))
    summed = (
        level.unionByName(own).unionByName(their).unionByName(both).groupBy("gid", "other").agg(F.sum("value").alias("value"))
    )
    pairs = summed.join(couples.select("gid", "other", "lang", "source", "item"), ["gid", "other"])
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))

    def part(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("lang", "source", F.lit(name).alias("part"), "item", F.col("value").cast("bigint").alias("value"), "rank")

    return part(pairs, "pair").unionByName(part(terms, "term"))


def audit_sql(least_docs: int = LEAST_DOCS, top: int = TOP) -> str:
    """The same in SQL over ``documents``, with every term of every group spelt out."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    p = f"1 + ({SCALE}::HUGEINT * (c + 1)) // (n + v)"
    far = "((p - q) * (p - q)) // q"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (
  SELECT r, lang, source, translate(unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), '{upper}', '{upper.lower()}') AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {least_docs}),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
lp AS (SELECT lang, term, {p} AS q FROM k JOIN v USING (lang)),
gc AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, sum(c) AS n FROM gc GROUP BY ALL),
gp AS (
  SELECT lang, source, term, c, {p} AS p
  FROM (SELECT g.lang, g.source, k.term, coalesce(gc.c, 0) AS c, coalesce(gn.n, 0) AS n, v.v
    FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source
    LEFT JOIN gc ON gc.lang = g.lang AND gc.source = g.source AND gc.term = k.term)),
s AS (
  SELECT lang, source, item, sum({far}) AS value
  FROM (SELECT a.lang, a.source, b.source AS item, a.p AS p, b.p AS q FROM gp a JOIN gp b USING (lang, term) WHERE a.source <> b.source)
  GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST({far} AS BIGINT) AS value FROM gp JOIN lp USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= {top}"""
