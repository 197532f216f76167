"""Word and n-gram counts by language as hashed tables, and their lookups, for ``word_backoff``.

Words travel as compressed blocks of text, one for each task and bucket of the words' hash; what is kept of
words and n-grams are 64-bit hashes with their counts by language, sorted, one block for each bucket.
Two words that share a hash count as one, which takes billions of words to be likely. Buckets are a
fixed part of the shuffle partitions, so a block is as large as a partition is meant to be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard

from caselink.llm.meeting import runs
from caselink.llm.texts import Rolling, slices

LONGEST = 5
HELD = 1_000_000
#: Words of documents in a pack.
PACK_WORDS = 4_000_000

LEARNT = "bucket int, lang string, words binary, ns binary"
TABLE = "kind int, bucket int, lang string, hashes binary, ns binary, total bigint, units bigint"
ASKED = "bucket int, pack bigint, at binary, words binary"
ANSWER = "pack bigint, kind int, bucket int, at binary, payload binary"
#: Kinds of answers: counts of known words, the text of unseen ones, and n-grams, asked for or known.
KNOWN, UNSEEN, GRAMS = -1, 0, 1

_LETTER: np.ndarray | None = None


def press(x: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes())


def unpress(x: bytes, kind=None):
    raw = zstandard.ZstdDecompressor().decompress(x)
    return raw if kind is None else np.frombuffer(raw, kind)


def _letters() -> np.ndarray:
    """Which code points are letters, as the regular expressions have it."""
    global _LETTER
    if _LETTER is None:
        points = np.r_[0:0xD800, 0xE000:0x110000].astype("<u4")
        text = points.tobytes().decode("utf-32-le")
        _LETTER = np.zeros(0x110000, bool)
        for m in regex.finditer(r"\p{L}+", text):
            _LETTER[points[m.start() : m.end()]] = True
    return _LETTER


class Spans:
    """Words as ranges of an array of code points."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.codes, self.starts, self.ends = codes, starts, ends

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        return Rolling(self.codes)(self.starts, self.ends) if len(self) else np.zeros(0, np.uint64)

    def take(self, at: np.ndarray) -> Spans:
        return Spans(self.codes, self.starts[at], self.ends[at])

    def _flat(self) -> tuple[np.ndarray, np.ndarray]:
        size = self.ends - self.starts
        at = np.arange(size.sum()) + np.repeat(self.starts - (np.cumsum(size) - size), size)
        return self.codes[at], size

    def strings(self) -> pa.Array:
        flat, size = self._flat()
        width = 1 + (flat >= 0x80).astype(np.int64) + (flat >= 0x800) + (flat >= 0x10000)
        ends = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(size)])]
        raw = flat.astype("<u4").tobytes().decode("utf-32-le").encode()
        return pa.LargeStringArray.from_buffers(len(self), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words' n-grams between two end marks, and the word of each."""
        flat, size = self._flat()
        whole = size + 2
        begin = np.cumsum(whole) - whole
        padded = np.zeros(int(whole.sum()), np.uint32)
        padded[begin], padded[begin + size + 1] = 2, 3
        inner = np.ones(len(padded), bool)
        inner[begin], inner[begin + size + 1] = False, False
        padded[inner] = flat
        word = np.repeat(np.arange(len(size)), whole)
        found = Rolling(padded).windows(n) if len(padded) else np.zeros(0, np.uint64)
        first = np.arange(len(found))
        inside = first + n <= (begin + whole)[word[: len(found)]]
        return found[inside], word[: len(found)][inside]


def words_of(texts: list[str | None]) -> tuple[Spans, np.ndarray]:
    """The words of lower-cased texts, and the first word of each text."""
    lowered = [(t or "").lower() for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le"), "<u4")
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in lowered])]).astype(np.int64)
    inside = _letters()[codes]
    edge = np.zeros(len(codes) + 1, bool)
    edge[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    first = np.flatnonzero(starts)
    return Spans(codes, first, np.flatnonzero(ends) + 1), np.searchsorted(first, offsets)


def block(strings: pa.Array) -> bytes:
    """Words as one compressed text; no word holds a line end."""
    cells = pa.ListArray.from_arrays(pa.array([0, len(strings)], pa.int32()), strings.cast(pa.string()))
    joined = pc.binary_join(cells, "\n")
    return press(joined[0].as_buffer().to_pybytes())


def unblock(blocks: list[bytes]) -> tuple[Spans, np.ndarray]:
    """The words of blocks one after another, and the number of each block's."""
    texts = [unpress(b).decode() for b in blocks]
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le"), "<u4")
    cuts = np.flatnonzero(codes == 10)
    return Spans(codes, np.r_[0, cuts + 1], np.r_[cuts, len(codes)]), np.array([t.count("\n") + 1 for t in texts])


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _first_of(code: np.ndarray) -> np.ndarray:
    lead = np.zeros(code.max() + 1 if len(code) else 0, np.int64)
    lead[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    return lead


def learn(buckets: int):
    """Word counts of a task by language, as blocks (``LEARNT``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            lang, hashes, n = (np.concatenate([h[i] for h in held]) for i in range(3))
            strings = pa.concat_arrays([h[3] for h in held])
            held.clear()
            size = 0
            bucket = bucket_of(hashes, buckets)
            order = np.lexsort((hashes, lang, bucket))
            lead = runs(bucket[order], lang[order], hashes[order])
            n, kept = np.add.reduceat(n[order], lead), order[lead]
            rows = runs(bucket[kept], lang[kept])
            ends = np.r_[rows[1:], len(kept)]
            names = list(langs)
            taken = strings.take(pa.array(kept))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[kept][rows].astype(np.int32)),
                    pa.array([names[k] for k in lang[kept][rows].tolist()], pa.string()),
                    pa.array([block(taken.slice(a, b - a)) for a, b in zip(rows.tolist(), ends.tolist())], pa.binary()),
                    pa.array([press(n[a:b]) for a, b in zip(rows.tolist(), ends.tolist())], pa.binary()),
                ],
                names=["bucket", "lang", "words", "ns"],
            )

        for batch in batches:
            lang_of = batch.column(0).to_pylist()
            for part in slices(batch.column(1)):
                words, first = words_of(batch.column(1).slice(int(part.rows[0]), len(part.rows)).to_pylist())
                if not len(words):
                    continue
                lang = np.array([langs.setdefault(lang_of[r], len(langs)) for r in part.rows.tolist()], np.int64)
                own = np.repeat(lang, np.diff(first))
                hashes = words.hashes()
                code, distinct = pd.factorize(hashes)
                pair, n = np.unique(own * len(distinct) + code, return_counts=True)
                of, which = np.divmod(pair, len(distinct))
                lead = _first_of(code)[which]
                held.append((of, hashes[lead], n, words.take(lead).strings()))
                size += len(pair)
                if size >= HELD:
                    yield flush()
        if held:
            yield flush()

    return run


def _table_rows(kind: int, buckets: np.ndarray, lang: str, hashes, ns, units: list[int]) -> Iterator[tuple]:
    """Rows of a table of one kind and language: a block for each bucket, its hashes rising."""
    order = np.lexsort((hashes, buckets))
    buckets, hashes, ns = buckets[order], hashes[order], ns[order]
    first = runs(buckets)
    for (a, b), u in zip(zip(first.tolist(), [*first[1:].tolist(), len(buckets)]), units):
        yield (kind, int(buckets[a]), lang, hashes[a:b].tobytes(), press(ns[a:b]), int(ns[a:b].sum()), u)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


TABLE_SCHEMA = pa.schema(
    [
        ("kind", pa.int32()), ("bucket", pa.int32()), ("lang", pa.string()), ("hashes", pa.binary()), ("ns", pa.binary()),
        ("total", pa.int64()), ("units", pa.int64()),
    ]
)
ANSWER_SCHEMA = pa.schema([("pack", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("at", pa.binary()), ("payload", pa.binary())])


def tabulate(buckets: int):
    """One bucket's words of all tasks: their table (kind 0), and their n-grams by the n-grams' buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        if not rows:
            return
        words, sizes = unblock([r["words"] for r in rows])
        ns = np.concatenate([unpress(r["ns"], np.int64) for r in rows])
        names = sorted({r["lang"] for r in rows})
        lang = np.repeat([names.index(r["lang"]) for r in rows], sizes)
        code, _ = pd.factorize(words.hashes())
        words = words.take(_first_of(code))
        counts = np.zeros((len(words), len(names)), np.int64)
        np.add.at(counts, (code, lang), ns)
        hashes, bucket = words.hashes(), rows[0]["bucket"]
        out = []
        for k, name in enumerate(names):
            some = np.flatnonzero(counts[:, k])
            own = np.full(len(some), bucket)
            # The distinct words of the bucket are counted once, with its first language.
            out += _table_rows(0, own, name, hashes[some], counts[some, k], [len(words) if k == 0 else 0])
            of = words.take(some)
            for n in range(1, LONGEST + 1):
                grams, word = of.grams(n)
                if len(grams):
                    distinct, at = np.unique(grams, return_inverse=True)
                    total = np.bincount(at, weights=counts[some, k][word]).astype(np.int64)
                    where = bucket_of(distinct, buckets)
                    out += _table_rows(n, where, name, distinct, total, [0] * buckets)
            yield _rows(out, TABLE_SCHEMA)
            out = []

    return run


def merge_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket's n-grams of all word buckets, added up."""
    rows = [r for b in batches for r in b.to_pylist()]
    for kind in sorted({r["kind"] for r in rows}):
        own = [r for r in rows if r["kind"] == kind]
        names = sorted({r["lang"] for r in own})
        hashes = [np.frombuffer(r["hashes"], np.uint64) for r in own]
        lang = np.repeat([names.index(r["lang"]) for r in own], [len(h) for h in hashes])
        distinct, at = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = np.zeros((len(distinct), len(names)), np.int64)
        np.add.at(counts, (at, lang), np.concatenate([unpress(r["ns"], np.int64) for r in own]))
        out = []
        for k, name in enumerate(names):
            some = np.flatnonzero(counts[:, k])
            where = np.full(len(some), own[0]["bucket"])
            out += _table_rows(kind, where, name, distinct[some], counts[some, k], [len(distinct) if k == 0 else 0])
        yield _rows(out, TABLE_SCHEMA)


class Packer:
    """Documents of a task in packs of ``PACK_WORDS`` words, named by the task and their number there."""

    def __init__(self):
        from pyspark import TaskContext

        self.name = TaskContext.get().partitionId() << 32
        self.clear()

    def clear(self) -> None:
        self.rows, self.sizes, self.hashes, self.strings, self.size = [], [], [], [], 0

    def packs(self, batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[tuple]:
        """``name, rows, words per document, place of each word, hashes and strings of the distinct ones``."""
        for batch in batches:
            for part in slices(batch.column(1)):
                at, n = int(part.rows[0]), len(part.rows)
                words, first = words_of(batch.column(1).slice(at, n).to_pylist())
                self.rows.append(batch.column(0).slice(at, n))
                self.sizes.append(np.diff(first))
                hashes = words.hashes()
                code, distinct = pd.factorize(hashes)
                lead = _first_of(code)
                self.hashes.append((hashes[lead], code))
                if with_text:
                    self.strings.append(words.take(lead).strings())
                self.size += len(words)
                if self.size >= PACK_WORDS:
                    yield self._whole(with_text)
        if self.rows:
            yield self._whole(with_text)

    def _whole(self, with_text: bool) -> tuple:
        every = np.concatenate([h for h, _ in self.hashes])
        code, distinct = pd.factorize(every)
        begins = np.cumsum([0, *(len(h) for h, _ in self.hashes)])
        places = np.concatenate([code[b : b + len(h)][c] for b, (h, c) in zip(begins, self.hashes)])
        strings = pa.concat_arrays(self.strings).take(pa.array(_first_of(code))) if with_text else None
        out = (self.name, self.rows, np.concatenate(self.sizes), places, np.asarray(distinct, np.uint64), strings)
        self.name += 1
        self.clear()
        return out


def ask(buckets: int):
    """The distinct words of every pack, by bucket (``ASKED``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, _, _, hashes, strings in Packer().packs(batches, True):
            if not len(hashes):
                continue
            bucket = bucket_of(hashes, buckets)
            order = np.argsort(bucket, kind="stable")
            first = runs(bucket[order])
            cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(order)]))
            taken = strings.take(pa.array(order))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[order][first].astype(np.int32)),
                    pa.array(np.full(len(cuts), name)),
                    pa.array([press(order[a:b].astype(np.int32)) for a, b in cuts], pa.binary()),
                    pa.array([block(taken.slice(a, b - a)) for a, b in cuts], pa.binary()),
                ],
                names=["bucket", "pack", "at", "words"],
            )

    return run


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``pack, rows, sizes, places, words``: the documents of every pack, by the places of their words."""
    for name, rows, sizes, places, hashes, _ in Packer().packs(batches, False):
        whole = pa.concat_arrays(rows)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([name]),
                pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole),
                pa.array([sizes.astype(np.int32).tobytes()], pa.binary()),
                pa.array([press(places.astype(np.int32))], pa.binary()),
                pa.array([len(hashes)], pa.int64()),
            ],
            names=["pack", "rows", "sizes", "places", "words"],
        )


def _lookup(rows: list[dict], langs: list[str], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts by language of the hashes in table blocks, and whether each is known at all."""
    counts, known = np.zeros((len(hashes), len(langs)), np.int64), np.zeros(len(hashes), bool)
    for r in rows:
        table = np.frombuffer(r["hashes"], np.uint64)
        at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
        found = table[at] == hashes
        known |= found
        counts[found, langs.index(r["lang"])] = unpress(r["ns"], np.int64)[at[found]]
    return counts, known


def answer_words(langs: list[str]):
    """Counts of a bucket's asked words that are known, and the text of the others (``ANSWER``)."""

    def run(key, asked: pa.Table, table: pa.Table) -> pa.Table:
        blocks, out = table.to_pylist(), []
        for r in asked.to_pylist():
            words, _ = unblock([r["words"]])
            counts, known = _lookup(blocks, langs, words.hashes())
            at = unpress(r["at"], np.int32)
            if known.any():
                out.append((r["pack"], KNOWN, r["bucket"], press(at[known]), press(counts[known])))
            if not known.all():
                new = np.flatnonzero(~known)
                out.append((r["pack"], UNSEEN, r["bucket"], press(at[new]), block(words.take(new).strings())))
        return pa.Table.from_batches([_rows(out, ANSWER_SCHEMA)]) if out else ANSWER_SCHEMA.empty_table()

    return run


def ask_grams(buckets: int):
    """Distinct n-grams of a pack's unseen words, a row for each of the n-grams' buckets.

    ``at`` holds the hashes, by length, and ``payload`` the number of each length.
    """

    def run(unseen: pa.Table) -> pa.Table:
        rows = unseen.to_pylist()
        words, _ = unblock([r["payload"] for r in rows])
        hashes = [np.unique(words.grams(n)[0]) for n in range(1, LONGEST + 1)]
        where = [bucket_of(h, buckets) for h in hashes]
        out = []
        for k in np.unique(np.concatenate(where)).tolist():
            own = [h[w == k] for h, w in zip(hashes, where)]
            sizes = np.array([len(h) for h in own], np.int64)
            out.append((rows[0]["pack"], GRAMS, k, np.concatenate(own).tobytes(), sizes.tobytes()))
        return pa.Table.from_batches([_rows(out, ANSWER_SCHEMA)])

    return run


def answer_grams(langs: list[str]):
    """The asked n-grams of a bucket that are known, and in ``payload`` their numbers and counts."""

    def run(key, asked: pa.Table, table: pa.Table) -> pa.Table:
        blocks, out = table.to_pylist(), []
        for r in asked.to_pylist():
            cuts = np.cumsum(np.frombuffer(r["payload"], np.int64))[:-1]
            found, parts = [], []
            for n, hashes in enumerate(np.split(np.frombuffer(r["at"], np.uint64), cuts), 1):
                counts, known = _lookup([b for b in blocks if b["kind"] == n], langs, hashes)
                found.append(hashes[known])
                parts.append(counts[known].ravel())
            sizes = np.array([len(h) for h in found], np.int64)
            if sizes.any():
                out.append((r["pack"], GRAMS, r["bucket"], np.concatenate(found).tobytes(), press(np.concatenate([sizes, *parts]))))
        return pa.Table.from_batches([_rows(out, ANSWER_SCHEMA)]) if out else ANSWER_SCHEMA.empty_table()

    return run


class Scale:
    """Logs of smoothed relative frequencies: half a count for what a language has not shown."""

    def __init__(self, langs: list[str], totals: dict[int, list[int]], units: dict[int, int]):
        self.langs, self.bases = langs, {k: np.array(t, float) + 0.5 * units[k] for k, t in totals.items()}

    def __call__(self, kind: int, counts: np.ndarray) -> np.ndarray:
        return np.log((counts + 0.5) / self.bases[kind]).astype(np.float32)


def word_scores(scale: Scale, words: int, answers: list[dict]) -> np.ndarray:
    """Scores of a pack's distinct words by language; zeros where not even a letter is known."""
    width = len(scale.langs)
    scores = np.zeros((words, width), np.float32)
    tables: dict[int, list] = {}
    for r in answers:
        if r["kind"] == KNOWN:
            scores[unpress(r["at"], np.int32)] = scale(0, unpress(r["payload"], np.int64).reshape(-1, width))
        elif r["kind"] == GRAMS:
            numbers = unpress(r["payload"], np.int64)
            sizes, counts = numbers[:LONGEST], numbers[LONGEST:].reshape(-1, width)
            cuts = np.cumsum(sizes)[:-1]
            for n, part in enumerate(zip(np.split(np.frombuffer(r["at"], np.uint64), cuts), np.split(counts, cuts)), 1):
                tables.setdefault(n, []).append(part)
    unseen = [r for r in answers if r["kind"] == UNSEEN]
    if not unseen:
        return scores
    left, _ = unblock([r["payload"] for r in unseen])
    at = np.concatenate([unpress(r["at"], np.int32) for r in unseen])
    for n in range(LONGEST, 0, -1):
        if n not in tables or not len(left):
            continue
        hashes = np.concatenate([h for h, _ in tables[n]])
        if not len(hashes):
            continue
        order = np.argsort(hashes)
        known, logs = hashes[order], scale(n, np.concatenate([c for _, c in tables[n]])[order])
        grams, word = left.grams(n)
        place = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        hit = known[place] == grams
        found = np.bincount(word[hit], minlength=len(left))
        some = found > 0
        for k in range(width):
            total = np.bincount(word[hit], weights=logs[place[hit], k], minlength=len(left))
            scores[at[some], k] = total[some] / found[some]
        left, at = left.take(np.flatnonzero(~some)), at[~some]
    return scores
