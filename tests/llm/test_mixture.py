"""Mixture-controlled packing against a round-by-round simulation and the library's own ids."""

from __future__ import annotations

import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from caselink.llm import mixture

WORDS = public_tokenizers.path("word_bpe_49k.json")


def library_ids(texts, path=WORDS, end_id=1):
    plain = Tokenizer.from_file(path)
    return [[*plain.encode(t or "", add_special_tokens=False).ids, end_id] for t in texts]


def simulate(tokens, window, quantum, shares=None):
    """Deficit round-robin, one round after another, with plain counters; then cut into sequences."""
    queue, rows = defaultdict(list), defaultdict(list)
    for r in sorted(tokens, key=lambda r: (r.part, r.before)):
        queue[r.source] += [(r, k) for k in range(r.n)]
        rows[r.source].append(r)
    everything = sum(map(len, queue.values()))
    names = sorted(queue, key=lambda s: (s is not None, s))
    quanta = {s: math.ceil(len(queue[s]) / quantum) for s in names}
    start = dict(START)
    out, sent, w = [], dict.fromkeys(names, 0), 0
    while any(sent[s] < quanta[s] for s in names):
        w += 1
        for s in names:
            share = (shares or {}).get(s, len(queue[s]) / everything)
            credit = min(math.floor(w * (share * window * quanta[s] / len(queue[s])) + start[s]), quanta[s])
            out += queue[s][sent[s] * quantum : credit * quantum]
            sent[s] = credit
    left, bounds = everything % window, list(range(0, everything - everything % window + 1, window))
    while left:
        size = 1 << (left.bit_length() - 1)
        bounds.append(bounds[-1] + size)
        left -= size
    pieces = []
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        for at in range(a, b):
            row, place = out[at]
            if at > a and out[at - 1][0] is row and out[at - 1][1] == place - 1 and pieces[-1][1] + pieces[-1][2] == place:
                pieces[-1][2] += 1
            else:
                pieces.append([row.doc_id, place, 1, k, at - a])
    return pieces


START: dict = {}


def starts_of(spark, sources):
    frame = spark.createDataFrame([(s,) for s in sources], "source string")
    at = (F.pmod(F.xxhash64(F.lit(13), "source"), F.lit(1 << 20)) + 0.5) / float(1 << 20)
    return {r.source: r.at for r in frame.select("source", at.alias("at")).collect()}


def merged(pieces):
    """Neighbouring pieces of one document as one, since a simulation cannot tell them apart."""
    out = []
    for doc, start, length, sequence, offset in pieces:
        if out and out[-1][0] == doc and out[-1][3] == sequence and out[-1][1] + out[-1][2] == start and out[-1][4] + out[-1][2] == offset:
            out[-1][2] += length
        else:
            out.append([doc, start, length, sequence, offset])
    return out


def corpus(rng, sources=("a", "b", "c", None, "rare"), weights=(0.5, 0.2, 0.15, 0.1, 0.05), n=120):
    words = ["alpha", "Beta", "γάμμα", "don't", "1234", "übung", "x<|endoftext|>y", "日本"]
    rows = []
    for i in range(n):
        size = int(rng.integers(0, 60)) if i % 17 else 700
        text = " ".join(rng.choice(words, size)) if i % 13 else None
        rows.append((i, text, "en", sources[int(rng.choice(len(sources), p=weights))]))
    return rows


@pytest.mark.parametrize("quantum", [1, 16, 50])
def test_pieces_equal_a_simulation(spark, docs, quantum):
    rows = corpus(np.random.default_rng(quantum))
    tokens = mixture.tokenised(docs(rows).repartition(5), WORDS)
    START.clear()
    START.update(starts_of(spark, {r[3] for r in rows}))
    found = mixture.pack_tokens(tokens, window=256, quantum=quantum).collect()
    got = merged(sorted(([r.doc_id, r.start, r.length, r.sequence_id, r.offset] for r in found), key=lambda p: p[3:]))
    assert got == merged(simulate(tokens.collect(), 256, quantum))
    assert mixture.Sequences(0, 256).starts.tolist() == [0]


def test_ids_are_the_librarys_and_each_lies_in_one_piece(spark, docs):
    rows = [*corpus(np.random.default_rng(5)), (500, "", "en", "a"), (501, " \n\t", "en", "b"), (7, "repeated id", "en", "c")]
    rows += [(900, "repeated row", "en", "a")] * 3
    found = mixture.pack_tokens(mixture.tokenised(docs(rows).repartition(3), WORDS), window=512).collect()
    by_doc = defaultdict(list)
    for r in found:
        ids = np.frombuffer(r.ids, "<u2").astype("<u4")
        assert len(ids) == r.length > 0 and r.ids_crc32 == zlib.crc32(ids.tobytes())
        by_doc[r.doc_id].append((r.start, r.doc_tokens, ids.tolist()))
    wanted = defaultdict(list)
    for row, ids in zip(rows, library_ids([r[1] for r in rows])):
        wanted[row[0]].append(ids)
    for doc, lists in wanted.items():
        assert sum(len(p[2]) for p in by_doc[doc]) == sum(map(len, lists))
        if len(lists) == 1:
            assert [i for p in sorted(by_doc[doc]) for i in p[2]] == lists[0]
            assert all(p[1] == len(lists[0]) for p in by_doc[doc])
    assert set(by_doc) == set(wanted)
    sizes = defaultdict(list)
    for r in found:
        sizes[r.sequence_id].append((r.offset, r.length))
    for k, spans in sizes.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 512 or (at & (at - 1) == 0 and k > max(sizes) - 10)
    assert sorted(sizes) == list(range(len(sizes)))


def test_every_window_holds_the_shares(spark, docs):
    """Also where the sources lie in blocks and one has most of the rows."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(["word"] * int(rng.integers(20, 300))), "en", s) for i, s in enumerate(["hot"] * 400 + ["b"] * 150 + ["c"] * 50)]
    found = mixture.pack_tokens(mixture.tokenised(docs(rows).coalesce(2), WORDS))
    table = defaultdict(lambda: defaultdict(int))
    for r in found.collect():
        table[r.sequence_id][r.source] += r.length
    total = sum(sum(t.values()) for t in table.values())
    whole = [t for t in table.values() if sum(t.values()) == 2048]
    assert len(whole) > 20
    for s in ("hot", "b", "c"):
        share = sum(t[s] for t in table.values()) / total
        assert max(abs(t[s] - 2048 * share) for t in whole) <= 3 * mixture.QUANTUM
    parts = mixture.sequences(found).collect()
    assert all(sum(p.length for p in r.pieces) == r.n_tokens for r in parts)


def test_targets_hold_until_a_queue_is_empty(spark, docs):
    rows = [(i, " ".join(["word"] * 100), "en", "a" if i < 100 else "b") for i in range(200)]
    tokens = mixture.tokenised(docs(rows), WORDS)
    targets = spark.createDataFrame([("a", 0.75), ("b", 0.25)], "source string, share double")
    found = mixture.pack_tokens(tokens, targets).collect()
    table = defaultdict(lambda: defaultdict(int))
    for r in found:
        table[r.sequence_id][r.source] += r.length
    assert sum(r.length for r in found) == 200 * 101
    for k in range(5):
        assert abs(table[k]["a"] - 1536) <= 48
    assert table[8]["a"] == 0 and table[8]["b"] == 2048


def test_odd_rows(spark, docs, odd):
    found = mixture.pack_tokens(mixture.tokenised(docs(odd), WORDS)).collect()
    assert sum(r.length for r in found) == sum(map(len, library_ids([t for _, t in odd])))
    assert {r.doc_id for r in found} == {i for i, _ in odd}
    assert mixture.pack_tokens(mixture.tokenised(docs([]), WORDS)).collect() == []
    clash = docs([(1, "a b", "en", "s")]).selectExpr("*", "1 as part", "2 as before", "'x' as ids", "3 as n", "4 as quanta", "5 as round")
    found = mixture.pack_tokens(mixture.tokenised(clash, WORDS)).collect()
    assert sorted((r.sequence_id, r.start, r.length) for r in found) == [(0, 0, 2), (1, 2, 1)]
