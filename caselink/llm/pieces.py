"""Token ids of many documents with the tokenizers library, every distinct piece encoded once.

Texts are cut into pieces that the tokenizer cannot join: a byte-level tokenizer at single spaces
between visible characters, one that drops white space at runs of ASCII white space. A task keeps the
ids of the pieces it has met in arrays sorted by a 64-bit hash; a second hash of 64 bits tells whether
a piece is the one that is known, so pieces are mixed up only if 128 bits agree. When the table is
full, the pieces that were met least often go.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd

from caselink.llm.texts import Rolling, Slice, word_spans

TABLE_PIECES = 1_500_000
JOINED = 512

#: Bytes beside a space at which byte-level texts may be cut: visible ASCII, and the Latin-1 letters'
#: lead byte after it, or any tail byte of such a letter before it.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True

#: One encoder per worker process and file, so that later tasks know the pieces of earlier ones.
_ENCODERS: dict[tuple, PieceEncoder] = {}


def encoder_of(path: str, words: bool = False) -> PieceEncoder:
    kind = WordEncoder if words else PieceEncoder
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = kind(path)
    return _ENCODERS[path, kind]


class PieceEncoder:
    """Encodes slices of documents with a byte-level tokenizers file."""

    def __init__(self, path: str, table_pieces: int = TABLE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.table_pieces = table_pieces
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        self.width = 2 if size <= 1 << 16 else 4
        # A byte-level token has one character for each of its bytes.
        self.bytes_of = np.zeros(size, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)
        self.first = np.zeros(0, np.uint64)  # sorted
        self.second = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.met = np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]

    def spans(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces, which cover the text."""
        buf, n = part.buf, len(part.buf)
        cut, letter = np.zeros(n + 1, bool), np.zeros(n, bool)
        letter[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80)
        before = _VISIBLE[buf[:-2]] | letter[:-2]
        after = _VISIBLE[buf[2:]] | (buf[2:] == 0xC3)
        cut[1 : n - 1] = (buf[1:-1] == 32) & before & after
        cut[part.offsets] = True
        edges = np.flatnonzero(cut)  # documents of no bytes share an edge
        return edges[:-1], edges[1:]

    def _fresh(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces one after another, and the number of ids of each.

        Pieces that begin with a space and a visible character and end visibly may stand between
        others of their kind, so many go into one text; their ids are told apart by their bytes.
        """
        size = ends - starts
        second, last, late = buf[np.minimum(starts + 1, ends - 1)], buf[ends - 1], buf[np.maximum(ends - 2, starts)]
        touching = (
            (size > 2)
            & (buf[starts] == 32)
            & (_VISIBLE[second] | (second == 0xC3))
            & (_VISIBLE[last] | ((late == 0xC3) & (last >= 0x80)))
        )
        raw = buf.tobytes()
        order = np.concatenate([np.flatnonzero(~touching), np.flatnonzero(touching)])
        cells = [raw[a:b] for a, b in zip(starts[order].tolist(), ends[order].tolist())]
        loose = len(cells) - int(touching.sum())
        texts = [c.decode() for c in cells[:loose]]
        texts += [b"".join(cells[k : k + JOINED]).decode() for k in range(loose, len(cells), JOINED)]
        flat = np.concatenate(self._ids(texts))
        stops = np.searchsorted(np.cumsum(self.bytes_of[flat]), np.cumsum(size[order])) + 1
        counts = np.diff(np.concatenate([[0], stops]))
        return flat, self._place_back(order, counts)

    def _place_back(self, order: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return order, counts

    def _forget(self) -> None:
        """Keep the half of the table that was met most often, or less."""
        least = 1
        while (self.met >= least).sum() > self.table_pieces // 2:
            least *= 2
        kept = self.met >= least
        self.first, self.second, self.place, self.size = (
            x[kept] for x in (self.first, self.second, self.place, self.size)
        )
        self.met = self.met[kept] // 2
        total = np.cumsum(self.size)
        start = total - self.size
        at = np.arange(total[-1] if len(total) else 0) + np.repeat(self.place - start, self.size)
        self.ids, self.place, self.used = self.ids[at], start, len(at)

    def _learn(self, buf, starts, ends, first, second) -> None:
        flat, (order, counts) = self._fresh(buf, starts, ends)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), 1 << 16), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        places = self.used + np.cumsum(counts) - counts
        self.used += len(flat)
        first, second = first[order], second[order]
        by = np.argsort(first, kind="stable")
        at = np.searchsorted(self.first, first[by])
        self.first = np.insert(self.first, at, first[by])
        self.second = np.insert(self.second, at, second[by])
        self.place = np.insert(self.place, at, places[by])
        self.size = np.insert(self.size, at, counts[by])
        self.met = np.insert(self.met, at, 0)

    def _find(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.first, first), max(len(self.first) - 1, 0))
        return at, (self.first[at] == first) if len(self.first) else np.zeros(len(first), bool)

    def _plain(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """The library on whole texts; used where two pieces agree in one hash but not in the other."""
        raw = part.buf.tobytes()
        cells = self._ids([raw[a:b].decode() for a, b in zip(part.offsets[:-1].tolist(), part.offsets[1:].tolist())])
        return np.concatenate(cells), np.array([len(c) for c in cells], np.int64)

    def encode(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice and the number of ids of each document."""
        nothing = np.zeros(0, np.uint32), np.zeros(len(part.rows), np.int64)
        if not len(part.buf):
            return nothing
        starts, ends = self.spans(part)
        if not len(starts):
            return nothing
        first, second = (Rolling(part.buf, k)(starts, ends) for k in (0, 1))
        code, distinct = pd.factorize(first)
        lead = np.zeros(len(distinct), np.int64)
        lead[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        if not np.array_equal(second, second[lead[code]]):
            return self._plain(part)
        # In order of the hash, so that the table is read from front to back.
        distinct = np.asarray(distinct, np.uint64)
        order = np.argsort(distinct)
        distinct, lead = distinct[order], lead[order]
        rank = np.zeros(len(order), np.int64)
        rank[order] = np.arange(len(order))
        code = rank[code]
        if len(self.first) + len(distinct) > self.table_pieces:
            self._forget()
        _, known = self._find(distinct)
        new = lead[~known]
        if len(new):
            self._learn(part.buf, starts[new], ends[new], first[new], second[new])
        at, _ = self._find(distinct)
        if not np.array_equal(self.second[at], second[lead]):
            return self._plain(part)
        self.met[at] += 1
        place, sizes = self.place[at][code], self.size[at][code]
        total = np.cumsum(sizes)
        index = np.arange(total[-1]) + np.repeat(place - (total - sizes), sizes)
        counts = np.concatenate([[0], total])[np.searchsorted(starts, part.offsets)]
        return self.ids[index], np.diff(counts)


class WordEncoder(PieceEncoder):
    """The same with a tokenizers file that drops white space and never joins text across it."""

    #: Stands between words; no word that holds it shares a text with others.
    MARK = b"\x01"

    def __init__(self, path: str, table_pieces: int = TABLE_PIECES):
        super().__init__(path, table_pieces)
        mark = self._ids([self.MARK.decode()])[0]
        if len(mark) != 1:
            raise ValueError("the mark between words must be one token")
        self.mark = mark[0]

    def spans(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, _ = word_spans(part)
        return starts, ends

    def _fresh(self, buf, starts, ends):
        raw = buf.tobytes()
        cells = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        marked = np.array([self.MARK in c for c in cells], bool)
        order = np.concatenate([np.flatnonzero(marked), np.flatnonzero(~marked)])
        alone = int(marked.sum())
        parts = self._ids([cells[i].decode() for i in order[:alone].tolist()])
        counts = [np.array([len(p) for p in parts], np.int64)]
        between = b" " + self.MARK + b" "
        rest = [cells[i] for i in order[alone:].tolist()]
        texts = [(between.join(rest[k : k + JOINED]) + between).decode() for k in range(0, len(rest), JOINED)]
        for ids in self._ids(texts):
            is_mark = ids == self.mark
            stops = np.flatnonzero(is_mark)
            counts.append(np.diff(np.concatenate([[-1], stops])) - 1)
            parts.append(ids[~is_mark])
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return flat, self._place_back(order, np.concatenate(counts))
