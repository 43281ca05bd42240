"""Texts to flat runs of token ids, many texts at once, exactly as the tokenizer's library gives them.

The normalising and the cutting into words are those of ``lexicon_bpe.Bpe``.  The chunks between white space of many texts are numbered together, each
different one is encoded once, and the ids of all texts are put together from those by index arithmetic.  New words are merged side by side: one
step of array arithmetic does the next merge of every word.
"""

from __future__ import annotations

import itertools

import numpy as np

from .lexicon_bpe import Bpe

#: About what a worker remembers, whatever the length of its chunks; the texts of one call come on top.
MOST_BYTES = 250_000_000
#: Widths, in bytes, of the tables in which words are merged side by side; longer words are merged one by one, by a heap.
WIDTHS = (8, 16, 48)
#: Words of one such table.
ROWS = 20_000
_NONE = np.iinfo(np.int32).max


class Words:
    """The ids of words."""

    def __init__(self, spec: str):
        self.bpe = bpe = Bpe(spec)
        pairs = sorted((a << 20 | b, r, new) for (a, b), (r, new) in bpe.rank.items())
        self.keys = np.array([p[0] for p in pairs] + [1 << 62], np.int64)
        self.ranks = np.array([p[1] for p in pairs] + [_NONE], np.int32)
        self.made = np.zeros(len(pairs) + 1, np.int32)
        self.made[self.ranks[:-1]] = [p[2] for p in pairs]
        self.first, self.last = np.array(bpe.first, np.int32), np.array(bpe.last, np.int32)
        # The ranks of pairs of single bytes: inside a word, and at its end.
        self.inside = self.rank(np.repeat(self.first, 256), np.tile(self.first, 256)).reshape(256, 256)
        self.at_end = self.rank(np.repeat(self.first, 256), np.tile(self.last, 256)).reshape(256, 256)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge; a number beyond all where there is none, or a part is -1."""
        key = (a.astype(np.int64) << 20) | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = len(self.keys) - 1
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], _NONE)

    def ids(self, words: list[str]) -> list[bytes]:
        """Each word's ids, as little-endian unsigned 32-bit numbers."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        out: list[bytes] = [b""] * len(raw)
        low = 0
        for width in WIDTHS:
            which = np.flatnonzero((size > low) & (size <= width))
            for i in range(0, len(which), ROWS):
                part = which[i : i + ROWS].tolist()
                for k, found in zip(part, self._side_by_side([raw[k] for k in part], width), strict=True):
                    out[k] = found
            low = width
        for k in np.flatnonzero(size > low).tolist():
            out[k] = np.array(self.bpe.merge(words[k]), "<u4").tobytes()
        return out

    def _side_by_side(self, raw: list[bytes], width: int) -> list[bytes]:
        n = len(raw)
        table = np.frombuffer(b"".join([r.ljust(width, b"\0") for r in raw]), np.uint8).reshape(n, width)
        size = np.fromiter(map(len, raw), np.int64, n)
        rows, cols = np.arange(n), np.arange(width + 1)
        # One column more stands for what is beyond either end of a word.
        symbol = np.full((n, width + 1), -1, np.int32)
        symbol[:, :width] = np.where(cols[:width] < size[:, None], self.first[table], -1)
        symbol[rows, size - 1] = self.last[table[rows, size - 1]]
        rank = np.full((n, width + 1), _NONE, np.int32)
        rank[:, : width - 1] = np.where(cols[1:width] < size[:, None] - 1, self.inside[table[:, :-1], table[:, 1:]], _NONE)
        two = np.flatnonzero(size > 1)
        rank[two, size[two] - 2] = self.at_end[table[two, size[two] - 2], table[two, size[two] - 1]]
        after = np.where(cols < size[:, None] - 1, cols + 1, width)
        before = np.where(cols > 0, cols - 1, width) + np.zeros((n, 1), np.int64)
        live = rows
        while True:
            now = rank[live]
            i = now.argmin(1)  # of equal ranks the first one, as in merging from the left
            least = now[np.arange(len(live)), i]
            going = least < _NONE
            live, i, least = live[going], i[going], least[going]
            if not len(live):
                break
            new = self.made[least]
            j, h = after[live, i], before[live, i]
            k = after[live, j]
            symbol[live, i], symbol[live, j] = new, -1
            after[live, i], before[live, k] = k, i
            rank[live, j] = _NONE
            rank[live, i] = self.rank(new, symbol[live, k])
            rank[live, h] = self.rank(symbol[live, h], new)
        kept = symbol >= 0
        flat = symbol[kept].astype("<u4").tobytes()
        ends = (4 * np.cumsum(kept.sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Numbers(dict):
    """Numbers keys as they come."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Stream:
    """Ids of many texts.  Chunks are remembered with their ids until they would take more than ``MOST_BYTES``; then it starts anew."""

    def __init__(self, spec: str):
        self.words = Words(spec)
        self.forget()

    def forget(self) -> None:
        self.number, self.held = Numbers(), 0
        #: By number: where a chunk's ids begin, and how many they are; the ids of all chunks.
        self.begin, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, "<u4")

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts one after the other as little-endian unsigned 32-bit numbers, where each text's ids end)."""
        bpe, flat, ends, special = self.words.bpe, [], [], {}
        for t in texts:
            if "<" in t and bpe.cut.search(t):
                for piece in bpe.cut.split(t):
                    if piece in bpe.special:
                        special[len(flat)] = bpe.special[piece]
                        flat.append("")
                    elif piece:
                        flat += bpe.chunks(piece)
            else:
                flat += bpe.chunks(t)
            ends.append(len(flat))
        if self.held > MOST_BYTES:
            self.forget()
        known = len(self.number)
        codes = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        if len(self.number) > known:
            self.learn([*itertools.islice(self.number, known, None)])
        begin, each = self.begin[codes], self.size[codes].astype(np.int64)
        pool = self.pool
        if special:
            where = list(special)
            begin[where], each[where] = len(pool) + np.arange(len(where)), 1
            pool = np.concatenate([pool, np.array(list(special.values()), "<u4")])
        upto = np.cumsum(each)
        at = np.repeat(begin - (upto - each), each)
        at += np.arange(len(at))
        return pool[at], np.concatenate([[0], upto])[np.array(ends, np.int64)]

    def learn(self, chunks: list[str]) -> None:
        """Encodes new chunks together."""
        cut = [self.words.bpe.words(c) for c in chunks]
        words = [*dict.fromkeys(w for ws in cut for w in ws)]
        of = dict(zip(words, self.words.ids(words), strict=True))
        found = [of[ws[0]] if len(ws) == 1 else b"".join([of[w] for w in ws]) for ws in cut]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        self.begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size.astype(np.int32)])
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(found), "<u4")])
        self.held += sum(map(len, chunks)) + 170 * len(chunks) + 4 * int(size.sum())
