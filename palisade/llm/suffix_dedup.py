"""Removal of every repeated byte string of a given length, over a sparse suffix array built by a prefix-aware distributed merge sort.

A byte goes if a string of ``length`` bytes that covers it starts at any other place too, in the same document or another.

1. Anchors.  A string's anchor is its gram (a shorter piece of fixed size) with the least hash, the leftmost if several are equal.
   Equal strings have their anchors at equal offsets, so only suffixes at anchors need sorting: one in some 70 positions,
   each speaking for the consecutive strings that it is the anchor of (its *span*).  Grams that occur once are dropped: nothing
   at them repeats.  Spans that occur whole twice or more are repeated whole; one of each remains as a partner for others.
2. Sort.  What is left are suffixes whose spans differ although their grams are the same.  Tasks sort them into runs, front-code these (a
   suffix is the length of the prefix that it shares with the one before, and the rest), and exchange runs.  A receiving task merges its
   runs by a loser tree whose players carry the prefix length that they share with the last winner; known prefixes are never
   compared again, and the shared prefix lengths of the merged order come out for free.
3. Strings.  A class is an interval of suffixes that share their gram.  Two suffixes that share r bytes to the right and l to
   the left of the anchor share exactly the strings at offsets length - r to l; both follow from minima over the prefix
   lengths in the sorted order (of the bytes to the right, and of those to the left).  The union over partners says which strings repeat.
4. Classes too large for a task (LIMIT) are halved by offset before the sort: each half's strings share a longer core, whose hash
   is the new class.  With one offset left all members are the same string, and nothing needs comparing.

Cases: a null text is empty; texts shorter than ``length`` keep all bytes.  Equal rows are places of their own, so both lose what they
share.  Rows are told apart by doc_id and a hash of the text; a null doc_id is a value of its own.  An empty table gives an
empty table.  Extra columns are left aside.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LIMIT = 8192
RUN = 20_000
_CHUNK = 1 << 22
_LOW = np.uint64((1 << 24) - 1)


def gram_size(length: int) -> int:
    return 8 * max(1, length // 25)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_hashes(raw: bytes, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from each position on; size is a multiple of 8."""
    n = len(raw)
    padded = np.frombuffer(raw + bytes(16), np.uint8)
    x = np.empty(n, np.uint64)
    for off in range(min(8, n)):
        part = x[off::8]
        part[:] = np.frombuffer(padded[off : off + 8 * len(part)].tobytes(), np.uint64)
    m = n - size + 1
    h = np.zeros(m, np.uint64)
    for j in range(size // 8):
        h += x[8 * j : 8 * j + m] * np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1) ^ 0x5851F42D4C957F2D << 1) & ((1 << 64) - 1) | 1)
    return _mix(h)


def spans(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first string, last string, gram hash) of each anchor of the text; strings are named by their first byte."""
    size = gram_size(length)
    width, out = length - size + 1, []
    for c in range(0, max(0, len(raw) - length + 1), _CHUNK):
        part = raw[c : c + _CHUNK + length - 1]
        h = gram_hashes(part, size)
        low = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        span, n = 1, len(h) - width + 1
        while 2 * span <= width:
            low = np.minimum(low[: len(low) - span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[:n], low[width - span : width - span + n])
        at = (low[:n] & _LOW).astype(np.int64)
        cut = np.flatnonzero(np.diff(at)) + 1
        first, last = np.append(0, cut), np.append(cut - 1, n - 1)
        out.append((at[first] + c, first + c, last + c, h[at[first]]))
    if not out:
        e = np.zeros(0, np.int64)
        return e, e, e, e.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _key() -> tuple[Column, Column]:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64(F.col("text").cast("string")).alias("t")


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """(d, t, p, lo, hi, gram, s): every anchor with its span and the span's hash."""

    def make():
        def of(batch):
            d, t = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            parts, sums, counts = [], [], []
            for text in common.texts(batch):
                raw = text.encode()
                p, lo, hi, gram = spans(raw, length)
                parts.append((p, lo, hi, gram))
                counts.append(len(p))
                sums += [xxhash.xxh64_intdigest(raw[a : b + length]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
            p, lo, hi, gram = (np.concatenate(x) for x in zip(*parts, strict=True))
            return {"d": np.repeat(d, counts), "t": np.repeat(t, counts), "p": p.astype(np.int32), "lo": lo.astype(np.int32), "hi": hi.astype(np.int32), "gram": gram.view(np.int64), "s": np.array(sums, np.uint64).view(np.int64)}

        return of

    return common.arrow_map(docs.select(*_key(), F.col("text").cast("string")), "d long, t long, p int, lo int, hi int, gram long, s long", make)


# A record is (class, left, right, least, d, t, at, open): the text's bytes from ``at`` on are right; those before, reversed, are left; the
# strings at offsets ``least`` to len(left) before ``at`` are its own; open: it wants to know which of them repeat.
_RECORD = "k long, left binary, right binary, least int, d long, t long, at int, open boolean, range int"


def records(docs: DataFrame, reps: DataFrame, length: int) -> DataFrame:
    """The contexts of the suffixes reps (d, t, p, lo, hi, gram, open), cut from their texts."""
    lists = reps.groupBy("d", "t").agg(F.collect_list(F.struct("p", "lo", "hi", "gram", "open")).alias("x"))
    rows = docs.select(*_key(), F.col("text").cast("string"))
    joined = rows.join(lists, ["d", "t"])
    width = length - gram_size(length)

    def make():
        def of(batch):
            out = []
            for d, t, text, xs in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                raw = text.encode()
                for x in xs:
                    p, lo, hi = x["p"], x["lo"], x["hi"]
                    out.append((x["gram"], raw[lo:p][::-1], raw[p : hi + length], p - hi, d, t, p, x["open"], width))
            return dict(zip(("k", "left", "right", "least", "d", "t", "at", "open", "range"), zip(*out, strict=True) if out else [[]] * 9, strict=True))

        return of

    return common.arrow_map(joined, _RECORD, make)


def halves(big: DataFrame, length: int) -> DataFrame:
    """Each record's offsets 0 to range as two records of half as many, in classes of the core that the half's strings share."""

    def make():
        def of(batch):
            out = []
            for _, left, right, least, d, t, at, open_, reach in zip(*[batch.column(i).to_pylist() for i in range(9)], strict=True):
                mid = reach // 2
                text, zero = left[::-1] + right, len(left)
                for x, y in ((0, mid), (mid + 1, reach)):
                    a, b = max(x, least), min(y, len(left))  # the record's own offsets in this half
                    if a <= b and x <= y:
                        core = text[zero - x : zero - y + length]
                        k = xxhash.xxh64_intdigest(core, seed=x * 1000 + y) - (1 << 63)
                        out.append((k, text[zero - b : zero - x][::-1], text[zero - x : zero - a + length], a - x, d, t, at - x, open_, y - x))
            return dict(zip(("k", "left", "right", "least", "d", "t", "at", "open", "range"), zip(*out, strict=True) if out else [[]] * 9, strict=True))

        return of

    return common.arrow_map(big, _RECORD, make)


def front_coded(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Sorted strings as (length shared with the string before, the rest)."""
    shared, rest, before = [], [], b""
    for s in strings:
        n = common_prefix(before, s, 0)
        shared.append(n)
        rest.append(s[n:])
        before = s
    return shared, rest


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    n = min(len(a), len(b))
    step = 32
    while known < n and a[known : known + step] == b[known : known + step]:
        known = min(n, known + step)
    while known < n and a[known] == b[known]:
        known += 1
    return known


class LoserTree:
    """Merges front-coded runs.  Players are runs; each carries its head and the prefix that the head shares with the last winner."""

    def __init__(self, runs: list[tuple[list[int], list[bytes]]]):
        self.runs, self.n = runs, len(runs)
        self.at = [0] * self.n
        self.head: list[bytes | None] = [r[1][0] if r[1] else None for r in runs]
        self.shared = [0] * self.n
        self.losers = [-1] * max(1, self.n)
        self.winner = self._build(1) if self.n > 1 else 0

    def _build(self, node: int) -> int:
        if node >= self.n:
            return node - self.n
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = self._play(a, b)
        self.losers[node] = lose
        return win

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser).  Heads are not below the last winner, so the one that shares more with it is the lesser; only a tie needs bytes, from there on."""
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if self.shared[a] != self.shared[b]:
            return (a, b) if self.shared[a] > self.shared[b] else (b, a)
        n = common_prefix(x, y, self.shared[a])
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            self.shared[b] = n
            return a, b
        self.shared[a] = n
        return b, a

    def __iter__(self) -> Iterator[tuple[int, int, int, bytes]]:
        """(run, place in the run, prefix shared with the string before, string), in order."""
        while (head := self.head[w := self.winner]) is not None:
            yield w, self.at[w], self.shared[w], head
            self.at[w] += 1
            shared, rest = self.runs[w]
            if self.at[w] < len(rest):
                self.shared[w] = shared[self.at[w]]
                self.head[w] = head[: self.shared[w]] + rest[self.at[w]]
            else:
                self.head[w] = None
            node = (w + self.n) // 2
            while node >= 1 and self.n > 1:
                w, self.losers[node] = self._play(w, self.losers[node])
                node //= 2
            self.winner = w


def repeated_offsets(shared: np.ndarray, lefts: list[bytes], opens: list[bool], length: int) -> list[tuple[int, int, int]]:
    """(member, first offset, last offset) of the repeated strings of a class's open members.

    shared[i]: bytes to the right that members i - 1 and i share; lefts: the members' reversed bytes to the left.
    """
    m, out = len(lefts), []
    if m == 2:
        lo, hi = length - int(shared[1]), common_prefix(lefts[0], lefts[1], 0)
        return [(i, max(lo, 0), hi) for i in (0, 1) if opens[i]] if lo <= hi else []
    order = sorted(range(m), key=lefts.__getitem__)
    rank = np.empty(m, np.int64)
    rank[order] = np.arange(m)
    left = np.array([0] + [common_prefix(lefts[a], lefts[b], 0) for a, b in zip(order, order[1:], strict=False)], np.int64)
    order = np.array(order)
    by_left, near = np.empty(m, np.int64), np.empty(m, np.int64)
    for i in range(m):
        if not opens[i]:
            continue
        near[i], j = -1, rank[i]
        near[i + 1 :] = np.minimum.accumulate(shared[i + 1 :])
        near[:i] = np.minimum.accumulate(shared[i:0:-1])[::-1]
        by_left[order[j + 1 :]] = np.minimum.accumulate(left[j + 1 :])
        by_left[order[:j]] = np.minimum.accumulate(left[j:0:-1])[::-1]
        lo = np.maximum(length - near, 0)
        ok = lo <= by_left
        ok[i] = False
        if ok.any():
            lo, hi = lo[ok], by_left[ok]
            cover = np.cumsum(np.bincount(lo, minlength=hi.max() + 2) - np.bincount(hi + 1, minlength=hi.max() + 2)) > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[False], cover, [False]])))
            out += [(i, int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]
    return out


def merged_strings(recs: DataFrame, length: int, parts: int) -> DataFrame:
    """(d, t, start, end): bytes of open records that repeated strings cover, by the sort and merge of all records."""

    def runs(batches):
        held: list[tuple] = []

        def flush():
            held.sort()
            i = 0
            while i < len(held):
                j, bucket = i, held[i][0]
                while j < len(held) and held[j][0] == bucket:
                    j += 1
                shared, rest = front_coded([x[1] for x in held[i:j]])
                yield bucket, pickle.dumps((shared, rest, [x[2:] for x in held[i:j]]))
                i = j
            held.clear()

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "run"])

        for batch in batches:
            for k, left, right, _, d, t, at, open_, _ in zip(*[batch.column(i).to_pylist() for i in range(9)], strict=True):
                u = k + (1 << 63)
                held.append((u % parts, u.to_bytes(8, "big") + right, left, d, t, at, open_))
            if len(held) >= RUN:
                yield batch_of(list(flush()))
        if held:
            yield batch_of(list(flush()))

    def merge(batches):
        def solve(parcels):
            loaded = [pickle.loads(x) for x in parcels]
            members: list[tuple] = []
            shared: list[int] = []

            def close():
                if len(members) > 1:
                    for i, a, b in repeated_offsets(np.array(shared, np.int64) - 8, [x[0] for x in members], [x[4] for x in members], length):
                        _, d, t, at, _ = members[i]
                        yield d, t, at - b, at - a + length

            for run, place, n, _ in LoserTree([x[:2] for x in loaded]):
                if n < 8 and members:
                    yield from close()
                    members.clear()
                    shared.clear()
                members.append(loaded[run][2][place])
                shared.append(n)
            yield from close()

        def done(parcels):
            found = list(solve(parcels))
            cols = list(zip(*found, strict=True)) if found else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["d", "t", "start", "end"])

        bucket, parcels = None, []
        for batch in batches:
            for b, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != bucket and parcels:
                    yield done(parcels)
                    parcels = []
                bucket = b
                parcels.append(run)
        if parcels:
            yield done(parcels)

    sent = recs.mapInArrow(runs, "bucket long, run binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, "d long, t long, start int, end int")


def covered(docs: DataFrame, length: int) -> DataFrame:
    """(d, t, start, end): pieces of texts that repeated strings cover; they may overlap."""
    spark = docs.sparkSession
    all_ = common.stored(anchors(docs, length), "anchors")
    total = all_.count()
    grams = all_.groupBy("gram").agg(F.count(F.lit(1)).alias("n_left"), F.min("s").alias("s0"), F.max("s").alias("s1")).where("n_left > 1")
    grams = common.stored(grams.select("gram", "n_left", (F.col("s0") != F.col("s1")).alias("many")), "grams")
    live = common.stored(common.spread_join(all_, grams, ["gram"], "inner", total).drop("n_left"), "live")
    common.unstore(all_)
    end = lambda c: (F.col(c) + length).alias("end")
    whole = live.where("not many").select("d", "t", F.col("lo").alias("start"), end("hi"))
    mixed = live.where("many").drop("many")
    by_span = mixed.groupBy("gram", "s").agg(F.count(F.lit(1)).alias("n_left"), F.min(F.struct("d", "t", "p", "lo", "hi")).alias("x"))
    by_span = common.stored(by_span, "spans")
    twice = common.spread_join(mixed, by_span.where("n_left > 1").select("gram", "s", "n_left"), ["gram", "s"], "inner", total).select("d", "t", F.col("lo").alias("start"), end("hi"))
    reps = by_span.select("x.*", "gram", (F.col("n_left") == 1).alias("open"))
    recs = common.stored(records(docs, reps, length), "suffixes")
    pieces = [whole, twice]
    n_recs = recs.count()
    while True:
        sizes = recs.groupBy("k").agg(F.count(F.lit(1)).alias("n_left"))
        large = common.stored(sizes.where(F.col("n_left") > LIMIT), "large")
        if not large.limit(1).count():
            pieces.append(merged_strings(recs, length, max(1, n_recs // RUN)))
            break
        # Fewer than records / LIMIT classes: a bound on what is broadcast.
        big = recs.join(F.broadcast(large.select("k")), "k", "left_semi")
        pieces.append(merged_strings(recs.join(F.broadcast(large.select("k")), "k", "left_anti"), length, max(1, n_recs // RUN)))
        same = big.where("range = 0 and open")  # classes of one string, many times
        pieces.append(same.select("d", "t", F.col("at").alias("start"), (F.col("at") + length).alias("end")))
        recs = common.stored(halves(big.where("range > 0").select(*recs.columns), length), "suffixes")
        n_recs = recs.count()
        if not n_recs:
            break
    out = spark.createDataFrame([], "d long, t long, start int, end int")
    for x in pieces:
        out = out.union(x)
    return out


def removed(docs: DataFrame, length: int = 200) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start,end>>, kept binary) for every row of docs: the maximal removed runs, and the bytes that stay."""
    lists = covered(docs, length).groupBy("d", "t").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("x"))
    lists = common.stored(lists, "covered")
    rows = docs.select(*_key(), F.col("doc_id").cast("long"), F.col("text").cast("string")).join(lists, ["d", "t"], "left").select("doc_id", "text", "x")

    def make():
        def of(batch):
            out = {"doc_id": batch.column(0), "n_bytes": [], "spans": [], "kept": []}
            for text, x in zip(common.texts(batch), batch.column(2).to_pylist(), strict=True):
                raw, runs = text.encode(), []
                for piece in x or ():
                    if runs and piece["start"] <= runs[-1]["end"]:
                        runs[-1]["end"] = max(runs[-1]["end"], piece["end"])
                    else:
                        runs.append(dict(piece))
                at, kept = 0, []
                for r in runs:
                    kept.append(raw[at : r["start"]])
                    at = r["end"]
                out["n_bytes"].append(len(raw))
                out["spans"].append(runs)
                out["kept"].append(b"".join([*kept, raw[at:]]))
            return out

        return of

    return common.arrow_map(rows, "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary", make)
