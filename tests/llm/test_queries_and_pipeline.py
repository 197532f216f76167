"""Registered queries and the pipeline over the smallest tables, against brute force."""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from test_mixture import library_ids
from test_near_and_substring import closure, cut_words, fingerprint
from test_rules_and_packing import brute_pack
from test_whitening import check as check_whitening

import __spark_entry__ as entry_point
import corpus_pipeline
from caselink.llm import rules

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")

COLUMNS = {
    1: {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    2: {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    3: {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    4: {"doc_id": "bigint", "perplexity": "double", "threshold": "double", "kept": "boolean"},
    5: {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    6: {"doc_id": "bigint", "item_id": "bigint", "score": "bigint"},
    7: {"doc_id": "bigint", "piece": "bigint", "bin_id": "bigint", "start": "bigint", "length": "bigint"},
    8: {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    9: {
        "doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
        "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean",
    },
    10: {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    11: {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
        "explained": "double", "identity_error": "double",
    },
    12: {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"},
    13: {
        "doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint",
        "sequence_id": "bigint", "offset": "bigint",
    },
}


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("n", range(1, 14))
def test_query_covers_its_table(spark, n):
    name = next(q for q in entry_point.queries() if q.startswith(f"op{n}_"))
    df = entry_point.queries()[name](spark, SF)
    kinds = dict(df.dtypes)
    assert COLUMNS[n].items() <= kinds.items()
    rows = df.collect()
    if n == 1:
        pages = spark.read.parquet(f"{SF}/pages.parquet")
        assert len(rows) == pages.count()
        assert all(r.n_chars == len(r.text) for r in rows)
    elif n == 11:
        vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
        check_whitening([(r.vec_id, r.embedding) for r in vectors], rows)
    elif n == 12:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
        sql = f"SELECT lang, source, part, item, value, rank FROM ({entry_point.oracle_sql()[name]})"
        assert sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()) == sorted(con.execute(sql).fetchall())
    elif n == 13:
        texts = {r.doc_id: r.text for r in documents(spark).collect()}
        ids = dict(zip(texts, library_ids(texts.values())))
        assert sum(r.length for r in rows) == sum(map(len, ids.values()))
        for r in rows:
            part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
            assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        ends = {}
        for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == ends.get(r.sequence_id, 0)
            ends[r.sequence_id] = r.offset + r.length
        sizes = [ends[k] for k in sorted(ends)]
        assert sizes == sorted(sizes, reverse=True) and all(n & (n - 1) == 0 and n <= 2048 for n in sizes)
    elif n not in (6, 7):
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in documents(spark).select("doc_id").collect())
    else:
        assert {r.doc_id for r in rows} <= {r.doc_id for r in documents(spark).select("doc_id").collect()}


def test_rules_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    sql = con.execute(entry_point.oracle_sql()["op9_quality_rules"])
    names = [d[0] for d in sql.description]
    expected = {r[0]: dict(zip(names, r)) for r in sql.fetchall()}
    got = {r.doc_id: r.asDict() for r in entry_point.queries()["op9_quality_rules"](spark, SF).collect()}
    assert got == expected


def test_languages_of_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in documents(spark).collect()}
    held = [r for r in entry_point.queries()["op2_language_id"](spark, SF).collect() if r.held_out]
    assert held and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_every_stage_equals_brute_force(spark, tmp_path):
    """Each stage is held against a plain Python version on the input that it was given."""
    docs = documents(spark)
    columns = docs.columns
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        frames[name] = (docs.collect(), spark.read.parquet(path).collect())
        docs = spark.read.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    key = lambda rows: Counter(tuple(r) for r in rows)

    before, after = frames["quality_rules"]
    verdict = {r.doc_id: r.kept for r in rules.judge(documents(spark)).collect()}
    assert key(after) == key(r for r in before if verdict[r.doc_id])
    assert len(after) < len(before)

    before, after = frames["simhash_near_dedup"]
    prints = {r.doc_id: fingerprint(r.text) for r in before}
    label = closure(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, p in prints.items():
        least[label[p]] = min(least.get(label[p], i), i)
    assert key(after) == key(r for r in before if r.doc_id in set(least.values()))

    before, after = frames["substring_dedup"]
    cut = {i: (gone, kept) for i, _, gone, kept in cut_words([(r.doc_id, r.text) for r in before])}
    for r in before:
        gone, kept = cut[str(r.doc_id)]
        new = next(x for x in after if x.doc_id == r.doc_id)
        assert new.text == (kept if gone else r.text)
        assert new.n_chars == (len(kept) if gone else r.n_chars)
        assert (new.lang, new.source) == (r.lang, r.source)
    assert len(after) == len(before)

    before, after = frames["benchmark_decontamination"]
    word = re.compile("[0-9a-z\u0080-￿]+")
    items = [word.findall(r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    copied = set()
    for r in before:
        text = " " + " ".join(word.findall(r.text.lower())) + " "
        if any(f" {' '.join(i)} " in text for i in items):
            copied.add(r.doc_id)
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert copied <= gone
    grams = {tuple(i[k : k + 5]) for i in items for k in range(len(i) - 4)}
    for r in before:
        w = word.findall(r.text.lower())
        if not any(tuple(w[k : k + 5]) in grams for k in range(len(w) - 4)):
            assert r.doc_id not in gone

    before, after = frames["best_fit_packing"]
    lengths = {r.doc_id: len(r.text.encode().split()) + 1 for r in before}
    placed = Counter()
    for r in after:
        placed[r.doc_id] += r.length
    assert placed == Counter(lengths)
    by_id = {r.doc_id: r for r in after}
    ids = sorted(lengths, key=lambda i: (-lengths[i], i))
    found = brute_pack([lengths[i] for i in ids], [by_id[i].source for i in ids], [by_id[i].cluster for i in ids], 4096)
    want = Counter()
    for _, _, b, _, n in found:
        want[b] += n
    got = Counter()
    for r in after:
        got[r.bin_id] += r.length
    assert sorted(want.values()) == sorted(got.values())


def test_pipeline_query_is_its_last_stage(spark):
    got = entry_point.queries()["pipeline"](spark, SF)
    assert {"doc_id", "bin_id", "start", "length"} <= set(got.columns) and got.count() > 0


def test_pipeline_of_odd_documents(spark, docs, odd, tmp_path):
    table = docs([*odd, (50, "The town of the north is a place that was made for the people and it has been there for us all.")])
    for name, stage in corpus_pipeline.STAGES:
        for frame in (table, table.limit(0)):
            path = str(tmp_path / f"{name}{frame is table}")
            stage(spark, frame, SF).write.parquet(path)
            assert spark.read.parquet(path).count() >= 0
    assert "text" in spark.read.parquet(str(tmp_path / "quality_rulesTrue")).columns
