"""SimHash near-duplicates: fingerprints, a binary-trie self-join, and components of the links.

Fingerprints are made where the documents lie, and only (id, fingerprint) pairs move. Equal
fingerprints are grouped first. Six bit blocks are then considered: two fingerprints that differ in
at most three bits agree in three whole blocks at least, so each choice of three blocks roots one
trie per value of those blocks, and the tries' node pairs are walked together over the other bits.
A node pair carries the bits differing so far and is dropped above the budget; a pair whose
remaining bits fit the budget is linked whole, without going down to its leaves.

A trie with more than ``TRIE_LEAVES`` leaves is rooted anew at three of six blocks of its free bits,
which leaves 16 free bits and so at most 65,536 leaves, whatever the data. Tries return spanning
links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselink.llm.components import components
from caselink.llm.meeting import with_key
from caselink.session import savepoint

BITS = 64
BUDGET = 3
SHINGLE = 3
SEED = 42
#: A plan parameter only: larger tries are split, and give the same links.
TRIE_LEAVES = 2048
FRONTIER = 200_000


def _signature(text: bytes) -> int:
    """The majority bits of the hashes of all word shingles, as an unsigned number."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE))))
    n = len(words) - SHINGLE + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):
        part = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        marks = np.fromiter(
            (_signature(t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in texts), np.uint64, len(texts)
        )
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(marks.view(np.int64))], names=["doc_id", "fp"]
        )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` of every row; a null or wordless text has fingerprint zero."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(_signatures, f"doc_id {kind}, fp bigint")


def _blocks(free: list[int]) -> list[list[int]]:
    """Six runs of near equal length of a list of bit positions."""
    ends = [round(len(free) * k / 6) for k in range(7)]
    return [free[a:b] for a, b in zip(ends, ends[1:])]


def _roots(free: list[int]) -> list[tuple[int, list[int]]]:
    """For each choice of three blocks: the mask of their bits, and the bits left free."""
    out = []
    for chosen in combinations(_blocks(free), 3):
        fixed = [b for block in chosen for b in block]
        out.append((sum(1 << b for b in fixed), [b for b in free if b not in set(fixed)]))
    return out


_FIRST = _roots(list(range(BITS - 1, -1, -1)))
#: Free bits of every kind of trie: 20 of the first kind, 20 below each of them.
_FREE: dict[int, list[int]] = {p: free for p, (_, free) in enumerate(_FIRST)}
_SECOND: dict[int, list[tuple[int, int]]] = {}
for _p, (_mask, _rest) in enumerate(_FIRST):
    _SECOND[_p] = []
    for _q, (_more, _left) in enumerate(_roots(_rest)):
        _kind = 20 + 20 * _p + _q
        _SECOND[_p].append((_kind, _mask | _more))
        _FREE[_kind] = _left


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _root_key(kind: int, mask: int) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.col("fp").bitwiseAND(F.lit(_signed(mask)).cast("bigint")).alias("key"))


def _second_keys() -> Column:
    choice = None
    for p, roots in _SECOND.items():
        keys = F.array(*[_root_key(kind, mask) for kind, mask in roots])
        choice = F.when(F.col("kind") == p, keys) if choice is None else choice.when(F.col("kind") == p, keys)
    return choice


def _compact(x: np.ndarray, free: list[int]) -> np.ndarray:
    """The free bits of each number, highest first, moved together."""
    out = np.zeros(len(x), np.uint64)
    for b in free:
        out = (out << np.uint64(1)) | ((x >> np.uint64(b)) & np.uint64(1))
    return out


class _Forest:
    """Labels of rows that have been linked so far."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.label[self.label]
                if np.array_equal(up, self.label):
                    break
                self.label = up


def _walk(tree: np.ndarray, rest: np.ndarray, width: int, budget: int) -> np.ndarray:
    """Component labels of the leaves of many tries, given as sorted (tree, rest bits) rows."""
    n = len(tree)
    forest = _Forest(n)
    whole = (tree.astype(np.uint64) << np.uint64(width)) | rest
    first = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
    last = np.r_[first[1:], n]
    many = last - first > 1
    zero = np.zeros(many.sum(), np.int64)
    stack = [(width, first[many], last[many], first[many], last[many], zero)]
    while stack:
        depth, al, ah, bl, bh, diff = stack.pop()
        if len(al) > FRONTIER:
            for at in range(0, len(al), FRONTIER):
                cut = slice(at, at + FRONTIER)
                stack.append((depth, al[cut], ah[cut], bl[cut], bh[cut], diff[cut]))
            continue
        own = al == bl
        # All that is left fits the budget: every leaf of both nodes is linked to one of them.
        fits = diff + depth <= budget
        # Two single leaves are settled by their bits.
        leaf = ~own & (ah - al == 1) & (bh - bl == 1) & ~fits
        if leaf.any():
            x, y = al[leaf], bl[leaf]
            near = np.bitwise_count(whole[x] ^ whole[y]) <= budget
            forest.link(x[near], y[near])
        if fits.any():
            for lo, hi in ((al[fits], ah[fits]), (bl[fits], bh[fits])):
                size = hi - lo
                at = np.repeat(lo, size)
                leaves = at + np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
                forest.link(leaves, np.repeat(al[fits], size))
        go = ~fits & ~leaf
        if not go.any():
            continue
        al, ah, bl, bh, diff, own = al[go], ah[go], bl[go], bh[go], diff[go], own[go]
        depth -= 1
        bit = np.uint64(1) << np.uint64(depth)

        def half(lo: np.ndarray, hi: np.ndarray, bit=bit, depth=depth) -> np.ndarray:
            above = (whole[lo] >> np.uint64(depth + 1)) << np.uint64(depth + 1)
            return np.clip(np.searchsorted(whole, above | bit), lo, hi)

        am, bm = half(al, ah), half(bl, bh)
        other = ~own
        parts = [
            (al, am, bl, bm, diff),
            (am, ah, bm, bh, diff),
            (al, am, bm, bh, diff + 1),
            (am[other], ah[other], bl[other], bm[other], diff[other] + 1),
        ]
        al, ah, bl, bh, diff = (np.concatenate(x) for x in zip(*parts))
        good = (ah > al) & (bh > bl) & (diff <= budget) & ~((al == bl) & (ah - al == 1))
        if good.any():
            stack.append((depth, al[good], ah[good], bl[good], bh[good], diff[good]))
    return forest.label


def _tries(budget: int):
    """Links of all tries of a partition that is sorted by (kind, key)."""

    def settle(kind: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        left, right = [], []
        for k in np.unique(kind):
            own = kind == k
            keys, prints = key[own], fp[own]
            rest = _compact(prints.view(np.uint64), _FREE[int(k)])
            tree = np.cumsum(np.r_[0, keys[1:] != keys[:-1]]).astype(np.int64)
            order = np.lexsort((rest, tree))
            label = _walk(tree[order], rest[order], len(_FREE[int(k)]), budget)
            prints = prints[order]
            linked = label != np.arange(len(label))
            left.append(prints[linked])
            right.append(prints[label[linked]])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            size += batch.num_rows
            if size < 100_000:
                continue
            kind, key, fp = (np.concatenate(x) for x in zip(*held))
            same = (kind == kind[-1]) & (key == key[-1])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield settle(kind[:cut], key[:cut], fp[:cut])
            held, size = [[kind[cut:], key[cut:], fp[cut:]]], len(kind) - cut
        if size:
            yield settle(*(np.concatenate(x) for x in zip(*held)))

    return run


def links(prints: DataFrame, budget: int = BUDGET, leaves: int = TRIE_LEAVES) -> DataFrame:
    """Spanning links ``a, b`` between distinct fingerprints (column ``fp``) within the budget."""
    if not 0 <= budget <= 3:
        raise ValueError("three equal blocks of six are certain for budgets of 0 to 3 only")
    rooted = prints.select(
        "fp", F.explode(F.array(*[_root_key(p, mask) for p, (mask, _) in enumerate(_FIRST)])).alias("root")
    ).select("fp", "root.kind", "root.key")
    sizes = savepoint(
        rooted.groupBy("kind", "key").agg(F.count("*").alias("n")).where("n > 1"), "tries"
    )
    shared = rooted.join(sizes, ["kind", "key"])
    here = F.array(F.struct(F.col("kind"), F.col("key")))
    placed = shared.select(
        "fp", F.explode(F.when(F.col("n") > leaves, _second_keys()).otherwise(here)).alias("root")
    ).select("root.kind", "root.key", "fp")
    return (
        placed.repartition("kind", "key")
        .sortWithinPartitions("kind", "key")
        .mapInArrow(_tries(budget), "a bigint, b bigint")
    )


def classes(docs: DataFrame, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` per row of ``docs``.

    The component is the smallest id reachable over links of at most ``budget`` differing bits, the
    row's own included. Repeated rows stay as they are; null ids never become a component's id
    unless no other id is there. An empty table gives no rows.
    """
    marked = savepoint(fingerprints(docs, id_col, text_col), "fingerprints")
    own = savepoint(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct_fingerprints")
    found = savepoint(
        components(links(own.select("fp"), budget)).select(F.col("node").alias("fp"), "component"),
        "components",
    )
    least = own.join(found, "fp").groupBy("component").agg(F.min("rep").alias("component_id"))
    named = savepoint(
        found.join(least, "component").select("fp", "component_id"), "named_components"
    )
    by_print = savepoint(
        own.join(named, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id")),
        "fingerprint_components",
    )
    return marked.join(by_print, "fp", "left").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """One whole row of ``docs`` per group of near copies: the row with the smallest id.

    Rows are told apart by id and text, so repeated and null ids are rows like others: each group keeps
    one, of the smallest id, a null id last. Equal rows leave one row. All columns are kept.
    """
    keyed = with_key(docs)
    named = savepoint(keyed.select("key", "row.doc_id").distinct(), "document_keys")
    found = classes(keyed.select("key", "text"), id_col="key").select(F.col("doc_id").alias("key"), "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    first = found.join(named, "key").groupBy("component_id").agg(F.min(order).alias("first")).select("first.key")
    kept = keyed.dropDuplicates(["key"]).join(savepoint(first, "first_of_group"), "key", "left_semi")
    return kept.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
