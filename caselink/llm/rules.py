"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Each rule bounds a count in hundredths of another count (words, lines), so verdicts are exact integer
comparisons. Texts are read whole. Null and empty texts have no words and fail the base rule. Null ids
and repeated rows are judged like any other row. Columns of the input other than id and text are
ignored, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
WINDOW = 8

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that for it was on are be with as at by this from or an have not "
    "der die das und ein eine in von zu mit ist den auf für im dem nicht des sich auch "
    "de la le et les des en un une du que est dans qui pour pas sur au par avec "
    "el y los se del las por con no una su para es al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= 100 * measure / per <= high``; a bound of None is open."""

    name: str
    measure: str
    per: str
    low: int | None = None
    high: int | None = None

    def holds(self) -> Column:
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (F.col(self.measure) * 100 >= F.col(self.per) * self.low)
        if self.high is not None:
            ok = ok & (F.col(self.measure) * 100 <= F.col(self.per) * self.high)
        return ok

    def sql(self) -> str:
        parts = []
        if self.low is not None:
            parts.append(f"100 * {self.measure} >= {self.low} * {self.per}")
        if self.high is not None:
            parts.append(f"100 * {self.measure} <= {self.high} * {self.per}")
        return " AND ".join(parts) or "true"


#: The base rules are named in the data contract, the others are the method's own verdict.
BASE = (Rule("enough_words", "n_words", "one", low=2000), Rule("few_repeats", "n_repeat_words", "n_words", high=30))
RULES = (
    Rule("word_length", "word_chars", "n_words", low=200, high=1500),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("exclamations", "n_exclamations", "n_words", high=10),
    Rule("stop_words", "n_stop_words", "n_words", low=4),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=35),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once, also where a lambda refers to it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated_windows(hashes: Column, n: Column) -> Column:
    """Words inside windows of eight whose word sequence occurs twice or more in the text."""

    def covered(windows: Column) -> Column:
        order = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twice = F.filter(
                s,
                lambda x, k: (F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
                | ((k > 0) & F.coalesce(F.get(s, F.greatest(k - 1, F.lit(0)))["h"] == x["h"], F.lit(False))),
            )
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def length(at: Column) -> Column:
            step = F.transform(
                at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW)))
            )
            return F.aggregate(step, F.lit(0).cast("bigint"), lambda a, x: a + x)

        return let(let(order, starts), length)

    windows = F.transform(
        F.sequence(F.lit(0), n.cast("int") - WINDOW),
        lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]),
    )
    some = let(
        windows,
        lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(covered(w)),
    )
    return F.when(n < WINDOW + 1, F.lit(0).cast("bigint")).otherwise(some)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the counts that the rules bound; only the two named columns are read."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, "[\\x20\\x09-\\x0D]+")
    )
    lines = F.filter(
        F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""
    )
    base = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text"))
    parts = base.select(id_col, "text", words.alias("words"), lines.alias("lines"))
    return parts.select(
        id_col,
        F.size("words").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.regexp_count(text, F.lit("!")).cast("bigint").alias("n_exclamations"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.size(F.filter("words", lambda w: w.isin(STOP_WORDS))).cast("bigint").alias("n_stop_words"),
        let(
            F.transform("words", lambda w: F.xxhash64(w)), lambda h: _repeated_windows(h, F.size(h))
        ).alias("n_repeat_words"),
    )


def judge(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    base: tuple[Rule, ...] = BASE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every document with its measures, ``base_failed``, the failed rules and ``kept``."""
    m = measures(docs, id_col, text_col).withColumn("one", F.lit(1).cast("bigint"))
    base_failed, ok = F.lit(False), F.lit(True)
    for rule in base:
        base_failed = base_failed | ~rule.holds()
    for rule in rules:
        ok = ok & rule.holds()
    failed = F.filter(
        F.array(*[F.when(~r.holds(), F.lit(r.name)) for r in (*base, *rules)]), lambda x: x.isNotNull()
    )
    return m.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_exclamations", "n_stop_words", "n_lines",
        base_failed.alias("base_failed"),
        (~base_failed & ok).alias("kept"),
        failed.alias("failed_rules"),
    )


def kept_rows(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass every rule, with all their columns, judged row by row."""
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    return judge(boxed, rules, id_col="row").where("kept").select("row.*")
