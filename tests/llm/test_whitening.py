"""Embedding whitening against a direct decomposition and exact whole numbers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from caselink.llm import whitening
from caselink.llm.spectrum import Spectrum, secular_roots

SCHEMA = "vec_id bigint, embedding array<float>"


def direct(vectors):
    """Plain version: exact deviations, covariance of the centred rows, numpy's eigenvectors."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(row, sums)] for row in x])
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1], turn[:, ::-1]
    return n, deviation, centred, values, turn


def check(rows, found, components=32):
    ids, vectors = [i for i, _ in rows], [v for _, v in rows]
    n, deviation, centred, values, turn = direct(vectors)
    k = min(components, int((values > 1e-11 * values.sum()).sum()))
    got = {(r.vec_id, r.component): r for r in found}
    assert len(found) == len(got) == n * k
    table = np.array([[got[i, c].whitened for c in range(1, k + 1)] for i in ids])
    wanted = centred @ turn[:, :k] / np.sqrt(values[:k])
    sign = np.sign((table * wanted).sum(axis=0))
    gap = np.min(np.abs(np.diff(values[: k + 1])), initial=np.inf) / values[0]
    assert np.abs(table - wanted * sign).max() < 1e-12 / min(gap, 1) * np.sqrt(values[0] / values[k - 1]) + 1e-10
    for j, i in enumerate(ids):
        assert {got[i, c].deviation for c in range(1, k + 1)} == {deviation[j]} and got[i, 1].n == n
    for c in range(1, k + 1):
        assert got[ids[0], c].explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-8


@pytest.mark.parametrize("size, count, block", [(5, 40, 7), (40, 300, 64), (40, 20, 2048), (1, 9, 3)])
def test_whitening_equals_a_direct_decomposition(spark, size, count, block):
    rng = np.random.default_rng(size + count)
    mixing = rng.normal(size=(size, size)) * np.exp(rng.normal(size=size))
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=size) @ mixing + 3]) for i in range(count)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(7), block=block).collect()
    check(rows, found)


def test_bad_rows_go_and_odd_tables_have_results(spark):
    rng = np.random.default_rng(4)
    good = [(i, [float(np.float32(c)) for c in rng.normal(size=4)]) for i in range(30)]
    bad = [(100, None), (101, [1.0, None, 0.0, 1.0]), (102, [float("nan"), 1.0, 1.0, 1.0]), (103, [float("inf"), 0.0, 0.0, 0.0]), (104, []), (105, [1.0])]
    frame = spark.createDataFrame([*good, *bad], SCHEMA).selectExpr("*", "1 as n", "'x' as v", "2 as size")
    check(good, whitening.whiten(frame).collect())
    repeated = good[:10] * 3 + [(None, good[0][1])]
    assert len(whitening.whiten(spark.createDataFrame(repeated, SCHEMA)).collect()) == 31 * 4
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [0.5, 2.0])] * 4, [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_huge_entries_do_not_crash(spark):
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 2.0])]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.vec_id, r.deviation) for r in found} == {(1, None), (2, None), (3, (3 * 128 - 192) ** 2)}


@pytest.mark.parametrize("kind", ["spread", "equal", "whole", "constant"])
def test_rank_one_changes_add_up(kind):
    rng = np.random.default_rng(1)
    x = {
        "spread": rng.normal(size=(60, 12)) * 10.0 ** rng.integers(-6, 6, 12),
        "equal": np.repeat(rng.normal(size=(3, 12)), 20, axis=0),
        "whole": np.floor(rng.normal(size=(60, 12)) * 3),
        "constant": np.ones((60, 12)),
    }[kind]
    one, two = Spectrum(12), Spectrum(12)
    for row in x[:25]:
        one.add_rows(row[None, :])
    two.add_rows(x[25:])
    one.add(two)
    centred = x - x.mean(axis=0)
    scatter = centred.T @ centred
    assert np.allclose(one.vectors * one.values @ one.vectors.T, scatter, rtol=0, atol=1e-12 * max(scatter.max(), 1))
    assert np.abs(one.vectors.T @ one.vectors - np.eye(12)).max() < 1e-12
    assert one.n == 60 and np.allclose(one.mean, x.mean(axis=0))


def test_roots_are_those_of_the_changed_matrix():
    rng = np.random.default_rng(2)
    for _ in range(50):
        k = int(rng.integers(1, 30))
        d, z, rho = np.sort(rng.normal(size=k)) * 10.0 ** rng.integers(-3, 3), rng.normal(size=k), float(np.exp(rng.normal()))
        roots, away = secular_roots(d, z, rho)
        assert np.allclose(roots, np.linalg.eigvalsh(np.diag(d) + rho * np.outer(z, z)), rtol=1e-12, atol=1e-12 * np.abs(roots).max())
        assert np.allclose(away, d[:, None] - roots)
