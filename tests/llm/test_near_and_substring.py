"""SimHash near-duplicates, components, and the two repeated-passage operators."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from caselink.llm import run_index, simhash, substring
from caselink.llm.components import components


def closure(nodes, near):
    """Components by search over all pairs."""
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if near(a, b) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_agree_with_spark_hash(spark, docs):
    table = docs([(1, "Alpha Beta")])
    own = simhash.fingerprints(table).first().fp
    assert own == spark.sql("SELECT xxhash64('alpha beta') AS h").first().h
    assert own & (2**64 - 1) == fingerprint("Alpha Beta")


@pytest.mark.parametrize("leaves", [2048, 4])
def test_trie_links_equal_all_pairs(spark, leaves):
    rng = random.Random(leaves)
    prints = {rng.getrandbits(64) for _ in range(60)}
    center = rng.getrandbits(64)
    for _ in range(250):
        x = center if rng.random() < 0.6 else rng.choice(sorted(prints))
        for b in rng.sample(range(64), rng.randint(1, 4)):
            x ^= 1 << b
        prints.add(x)
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    want = closure(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    links = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp bigint"), leaves=leaves)
    got = {r.node: r.component for r in components(links).collect()}
    for a in signed:
        assert got.get(a, a) == want[a]


def test_classes_equal_brute_force(docs, odd):
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(80)) for _ in range(8)]
    rows = [*odd]
    for i in range(60):
        words = rng.choice(base).split()
        if i % 3:
            words[rng.randrange(80)] = "zz"
        rows.append((100 + i, " ".join(words)))
    got = simhash.classes(docs(rows)).collect()
    assert len(got) == len(rows)
    prints = [fingerprint(t) for _, t in rows]
    label = closure(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[label[p]] = min(least.get(label[p], i), i)
    expected = sorted((str(i), p, str(least.get(label[p]))) for (i, _), p in zip(rows, prints))
    assert sorted((str(r.doc_id), r.fp & (2**64 - 1), str(r.component_id)) for r in got) == expected


def test_representatives_lose_no_text(docs):
    """Rows that copy nothing stay, whatever their ids; of copies the smallest id stays, a null id last."""
    one, two, three = ("alpha beta gamma delta epsilon zeta", "completely other words stand in this line", "null ids have texts of their own")
    rows = [(1, one), (1, two), (2, one), (None, three), (None, three), (5, three), (None, "lonely words without any id"), (7, two), (7, two)]
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in simhash.representatives(docs(rows).repartition(4)).collect())
    assert kept == sorted([(False, 1, one), (False, 1, two), (False, 5, three), (True, 0, "lonely words without any id")])


def test_representatives_keep_whole_rows(docs):
    table = docs([(3, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "quite other words here"), (None, "a b c d")])
    kept = simhash.representatives(table)
    assert kept.columns == table.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2"]
    assert simhash.representatives(table.limit(0)).count() == 0


def test_components_of_a_chain_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (100, 101)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 140)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def cut_words(rows, window=35):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(b" ".join(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for s in range(len(w) - window + 1):
            if seen[b" ".join(w[s : s + window])] > 1:
                gone.update(range(s, s + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(i), len(w), len(gone), kept.decode()))
    return sorted(out)


def passages(rng, n=40):
    shared = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([34, 35, 36, 60, 200]))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts.append(rng.choice(shared) if rng.random() < 0.5 else " ".join(f"u{rng.random()}" for _ in range(rng.randint(0, 50))))
        rows.append((1000 + i, rng.choice([" ", "\n", "  "]).join(parts)))
    rows += [(2000, "ha " * 200), (2001, "x y " * 18), (2002, "q " * 34), (2003, " ".join(map(str, range(36))))]
    rows += [(2004, " ".join([*map(str, range(50, 65)), *map(str, range(9)), *map(str, range(50, 65))])), rows[0], rows[1]]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_equals_brute_force(docs, odd, seed):
    rows = [*odd, *passages(random.Random(seed))]
    got = substring.remove_repeats(docs(rows)).collect()
    assert sorted((str(r.row.doc_id), r.n_words, r.n_removed, r.kept_text) for r in got) == cut_words(rows)


def test_substring_dedup_of_nothing(docs):
    assert substring.remove_repeats(docs([])).count() == 0


def test_cover_is_a_difference_cover():
    differences = {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER}
    assert differences == set(range(substring.PERIOD))


def cut_bytes(rows, window=200):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(x[s : s + window] for x in texts for s in range(len(x) - window + 1))
    out = []
    for (i, _), x in zip(rows, texts):
        mark = np.zeros(len(x) + 1, int)
        for s in range(len(x) - window + 1):
            if seen[x[s : s + window]] > 1:
                mark[s] += 1
                mark[s + window] -= 1
        gone = np.cumsum(mark[:-1]) > 0
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(x) else 0
        out.append((str(i), len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("crowd", [256, 2])
def test_run_index_dedup_equals_brute_force(docs, odd, crowd):
    rows = [*odd, *passages(random.Random(7), 25), (3000, "é" * 300), (3001, "a" * 199), (3002, "a" * 200), (3003, "ab" * 150)]
    got = run_index.remove_repeats(docs(rows), crowd=crowd).collect()
    found = [(str(r.row.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got]
    assert sorted(found) == cut_bytes(rows)


def test_run_index_of_a_text_in_stretches(docs, monkeypatch):
    rng = random.Random(3)
    shared = "".join(rng.choice("abc ") for _ in range(700))
    long = "".join(rng.choice("defg ") for _ in range(3000))
    rows = [(1, long[:1500] + shared + long[1500:]), (2, shared + "tail"), (3, long)]
    whole = sorted(tuple(r)[1:] for r in run_index.remove_repeats(docs(rows)).select("row.doc_id", "n_removed", "n_spans").collect())
    expected = sorted((r[2], r[3]) for r in cut_bytes(rows))
    assert sorted(whole) == expected


def test_matching_statistics_equal_brute_force():
    rng = random.Random(2)
    for t in range(25):
        base = bytes(rng.randrange(3) for _ in range(40))
        strings = [base[a : a + rng.randint(0, 25)] for a in (rng.randrange(30) for _ in range(rng.randint(1, 9)))]
        index = run_index.RunIndex(strings)
        found, at = index.matching_statistics(), 0
        places = [(j, k) for j, y in enumerate(strings) for k in range(len(y))]
        for i, x in enumerate(strings):
            for k in range(len(x)):
                best = 0
                for j, m in places:
                    if (i, k) != (j, m):
                        n = 0
                        while k + n < len(x) and m + n < len(strings[j]) and x[k + n] == strings[j][m + n]:
                            n += 1
                        best = max(best, n)
                assert found[at + k] == best
            at += len(x) + 1


def test_repetitive_texts_have_few_runs():
    index = run_index.RunIndex([b"the same words again and again " * 20] * 8)
    assert len(index.heads) == len(index.tails) < index.n / 10
