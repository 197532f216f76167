"""The source divergence audit against a plain Python version and its SQL."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from caselink.llm import divergence

TERM = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=3, top=200):
    """Every kept term of every group spelt out, in Python's own whole numbers."""
    rows = [tuple(x or "" for x in r) for r in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        docs, groups = Counter(), defaultdict(Counter)
        for text, own, source in rows:
            if own == lang:
                found = [t.translate(LOWER) for t in TERM.findall(text)]
                docs.update(set(found))
                groups[source].update(found)
        kept = sorted(t for t, n in docs.items() if n >= least)

        def shares(count):
            total = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (count[t] + 1) // total for t in kept}

        everywhere = shares(sum(groups.values(), Counter()))
        of = {s: shares(c) for s, c in groups.items()}
        for s, p in of.items():
            pair = [(sum((p[t] - q[t]) ** 2 // q[t] for t in kept), o) for o, q in of.items() if o != s]
            term = [((p[t] - everywhere[t]) ** 2 // everywhere[t], t) for t in kept if groups[s][t] and p[t] > everywhere[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(ordered, 1)}
    return out


def rows_of(frame):
    rows = [tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(rng, n=150):
    words = ["the", "The", "alpha", "beta", "gamma", "übung", "Übung", "日本", "e2e", "x-y", "don't", *(f"w{chr(97 + k)}" for k in range(26))]
    rare = ["zeta", "eta", "iota"]
    rows = []
    for i in range(n):
        source = rng.choice(["hot", "hot", "hot", "b", "c"])
        text = " ".join(rng.choice(words if source != "c" else words[:12], int(rng.integers(0, 30))))
        if rng.random() < 0.1:
            text += " " + rare[i % 3]
        rows.append((text, str(rng.choice(["en", "de"])), str(source)))
    return [
        *rows, (None, "en", "null text"), ("123 !!", "en", "no terms"), ("alpha alpha the", None, "b"), ("alpha the", "", None),
        ("the alpha", None, None), ("lonely words", "xx", "one"), *[("the same row", "en", "b")] * 4,
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string")


@pytest.mark.parametrize("bits", [64, 4])
def test_audit_equals_a_plain_version(spark, bits):
    """Digests of four bits collide for most terms, which are then split."""
    rows = corpus(np.random.default_rng(bits))
    assert rows_of(divergence.audit(frame(spark, rows).repartition(3), bits=bits)) == plain(rows)


def test_ties_at_the_cut_go_by_item(spark):
    rows = [(f"{a} {b}", "en", "a") for a in "xyzuvw" for b in "klm"] + [("k other other", "en", "b")] * 3
    assert rows_of(divergence.audit(frame(spark, rows), top=4)) == plain(rows, top=4)


def test_sql_equals_the_audit(spark):
    import pandas as pd

    rows = corpus(np.random.default_rng(9))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["text", "lang", "source"]))
    got = con.execute(f"SELECT lang, source, part, item, value, rank FROM ({divergence.audit_sql()})").fetchall()
    assert set(got) == plain(rows) and len(got) == len(set(got))


def test_nothing_and_clashing_names(spark):
    assert divergence.audit(frame(spark, [])).collect() == []
    odd = frame(spark, [("a b", "en", "s"), (None, "en", "r")]).selectExpr("*", "1 as n", "2 as gid", "'q' as term", "3 as docs", "4 as lid")
    assert rows_of(divergence.audit(odd)) == {("en", "s", "pair", "r", 0, 1), ("en", "r", "pair", "s", 0, 1)}


def test_exact_shares(spark):
    big = [(0, 1), (1, 3), (10**12, 10**13 + 7), (10**13, 10**13), (7, 9)]
    frame = spark.createDataFrame(big, "c bigint, t bigint")
    assert [r[0] for r in frame.select(divergence.share(frame.c, frame.t)).collect()] == [10**9 * c // t for c, t in big]
