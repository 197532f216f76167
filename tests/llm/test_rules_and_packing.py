"""Quality rules and best-fit packing."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import duckdb
import pytest

from caselink.llm import packing, rules
from caselink.llm.queries import ORACLE

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    words = WORDS.findall(text or "")
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def random_texts(seed=1, n=60):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        vocabulary = ["the", "a", "b#", "|", "é", "x y", "of"][: rng.randint(2, 7)]
        out.append("".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\n", "\t", " \n"]) for _ in range(rng.randint(0, 60))))
    return out


def test_measures_equal_brute_force(docs, odd):
    rows = [*odd, *enumerate(random_texts(), start=100), (900, "word " * 5000), (901, "a b c d e f g h " * 3)]
    got = rules.judge(docs(rows)).collect()
    assert len(got) == len(rows)
    left = sorted((r[0] if r[0] is not None else -1, tuple(measured(r[1]).values())) for r in rows)
    right = sorted((r.doc_id if r.doc_id is not None else -1, tuple(r[k] for k in measured(""))) for r in got)
    assert left == right
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
        assert r.kept == (not r.failed_rules)


def test_measures_equal_sql(spark, docs, odd):
    rows = [*odd, *enumerate(random_texts(2), start=100)]
    table = docs(rows)
    con = duckdb.connect()
    con.register("documents", table.toArrow())
    sql = con.execute(ORACLE["op9_quality_rules"])
    names = [d[0] for d in sql.description]
    key = lambda r: str(sorted(r.items()))
    expected = sorted((dict(zip(names, row)) for row in sql.fetchall()), key=key)
    got = sorted((r.asDict() for r in rules.judge(table).drop("failed_rules").collect()), key=key)
    assert got == expected


def test_one_projection_without_python(docs):
    plan = rules.judge(docs([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_clean_text_is_kept_and_junk_is_not(docs):
    clean = "The town of the north is a place that was made for the people and it has been there with them for years."
    rows = [
        (1, clean), (2, " ".join(w + "***" for w in clean.split())), (3, clean.upper().replace(" ", "!! ")),
        (4, "the cat " * 30), (5, " | ".join(clean.split())), (6, "short"), (7, None),
    ]
    assert {r.doc_id for r in rules.judge(docs(rows)).where("kept").collect()} == {1}


def test_kept_rows_keep_all_columns(docs):
    clean = "The town of the north is a place that was made for the people and it has been there with them for years."
    table = docs([(1, clean, "en", "s", 3, 7), (2, "bad", "en", "s", 4, 8)], "words bigint, row bigint")
    kept = rules.kept_rows(table)
    assert kept.columns == table.columns and [r.row for r in kept.collect()] == [7]
    assert rules.kept_rows(table.limit(0)).count() == 0


def brute_pack(lengths, sources, clusters, capacity):
    """The rule of the packing, with a full search of all bins for each piece."""
    pieces = []
    for i, n in enumerate(lengths):
        pieces += [(capacity, i, k) for k in range(n // capacity)]
        if n % capacity or not n // capacity:
            pieces.append((n % capacity, i, n // capacity))
    bins, out = [], []
    for n, i, k in sorted(pieces, key=lambda p: (-p[0], p[1], p[2])):
        fits = [
            (b["room"], j)
            for j, b in enumerate(bins)
            if b["room"] >= max(n, 1)
            and not (sources[i] is not None and sources[i] in b["sources"])
            and not (clusters[i] is not None and clusters[i] in b["clusters"])
        ]
        if fits:
            j = min(fits)[1]
        else:
            bins.append({"room": capacity, "sources": set(), "clusters": set()})
            j = len(bins) - 1
        out.append((i, k, j, capacity - bins[j]["room"], n))
        bins[j]["room"] -= n
        bins[j]["sources"].add(sources[i])
        bins[j]["clusters"].add(clusters[i])
    return out


@pytest.mark.parametrize("seed", range(8))
def test_a_shard_is_packed_as_by_full_search(seed):
    import numpy as np

    rng = random.Random(seed)
    n = rng.randint(1, 150)
    lengths = np.array([rng.choice([0, 1, 50, 99, 100, 101, 250, rng.randint(0, 130)]) for _ in range(n)])
    sources = [rng.choice([None, *"abcdefgh"]) for _ in range(n)]
    clusters = [rng.choice([None, *range(40)]) for _ in range(n)]
    assert packing.pack_shard(lengths, sources, clusters, 100) == brute_pack(lengths.tolist(), sources, clusters, 100)


def test_packing_of_a_table(spark):
    rng = random.Random(5)
    rows = [
        (i, rng.choice([0, 5, 30, 64, 65, 400]), "hot" if i % 3 else f"s{i % 7}", rng.choice([None, i % 20]))
        for i in range(300)
    ]
    rows += rows[:5]
    table = spark.createDataFrame(rows, "doc_id bigint, length bigint, source string, cluster bigint")
    got = packing.pack(table, capacity=64, shard_pieces=100).collect()
    total, by_bin = defaultdict(int), defaultdict(list)
    for r in got:
        total[r.doc_id] += r.length
        by_bin[r.bin_id].append(r)
    expected = defaultdict(int)
    for i, length, *_ in rows:
        expected[i] += length
    assert total == expected
    for pieces in by_bin.values():
        at = 0
        for r in sorted(pieces, key=lambda r: (r.start, r.length)):
            assert r.start == at
            at += r.length
        assert at <= 64
        sources = [r.source for r in pieces if r.source is not None]
        clusters = [r.cluster for r in pieces if r.cluster is not None]
        assert len(set(sources)) == len(sources) and len(set(clusters)) == len(clusters)
    assert packing.pack(table.limit(0)).count() == 0
    # Without the source rule a bin may hold a source twice.
    loose = packing.pack(table, capacity=64, by_source=False).collect()
    assert len({r.bin_id for r in loose}) < len(by_bin)


def test_lengths_and_clusters(docs, odd):
    rows = packing.measured(docs([*odd, (8, "ONE")])).collect()
    lengths = sorted((r.doc_id or 0, r.length) for r in rows)
    assert (1, 1) in lengths and (3, 1) in lengths and (5, 3) in lengths and (0, 5) in lengths
    assert len({r.cluster for r in rows if r.doc_id in (4, 8)}) == 1
