"""Best-fit packing of documents into training sequences, by exact complements.

A document is its ids and a separator.  Only documents longer than a sequence are cut.  How pieces are put together depends on their lengths
alone, and there are at most ``capacity`` different lengths, so the plan is made from one count a length, however large the corpus is:
open a sequence with the longest piece left, and fill its gap exactly with one, two or three pieces (sums of up to three lengths are indexed,
and a combination is used as often as its lengths last); what no combination fills goes by best fit.  The plan says, for the
pieces of a length in any fixed order, in which sequences they lie; each piece then finds its place from its rank alone.

Cases: a null or empty text is a separator only.  Equal rows are packed one by one, rows without an id too.  An empty table gives an
empty table.  Extra columns are left aside.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .token_stream import Stream

#: Characters of text that a task encodes at once.
CHARS = 4_000_000


class Sums:
    """Which sums of one, two or three lengths still at hand there are: in how many orders each comes about."""

    def __init__(self, counts: np.ndarray):
        self.left = counts
        self.one = (counts > 0).astype(np.int64)
        self.two = np.convolve(self.one, self.one)[: len(counts)]
        self.three = np.convolve(self.two, self.one)[: len(counts)]

    def gone(self, x: int) -> None:
        """Takes a length out of the indices."""
        size = len(self.one)

        def shifted(a: np.ndarray, by: int) -> np.ndarray:
            out = np.zeros_like(a)
            if by < size:
                out[by:] = a[: size - by]
            return out

        # (one - x)^3 = three - 3 x two + 3 x^2 one - x^3, and likewise for two.
        single = np.zeros_like(self.one)
        single[0] = 1
        self.three += 3 * shifted(self.one, 2 * x) - 3 * shifted(self.two, x) - shifted(single, 3 * x)
        self.two += shifted(single, 2 * x) - 2 * shifted(self.one, x)
        self.one[x] = 0

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for x in lengths:
            self.left[x] -= times
        for x in set(lengths):
            if not self.left[x] and self.one[x]:
                self.gone(x)

    def lasts(self, lengths: tuple[int, ...]) -> int:
        """How often these lengths can be taken together."""
        return min(int(self.left[x]) // lengths.count(x) for x in set(lengths))

    def exact(self, first: int, capacity: int, most: int = 3) -> tuple[int, ...] | None:
        """The lengths of a full sequence that ``first`` opens: with as few others as can be (``most`` at most), the longest of them first."""
        gap = capacity - first
        if not gap:
            return (first,)
        for more, index in ((1, self.one), (2, self.two), (3, self.three)):
            if more <= most and index[gap]:
                for rest in self._made_of(gap, more, gap):
                    if self.lasts((first, *rest)):
                        return (first, *rest)
        return None

    def _made_of(self, total: int, more: int, most: int):
        """Lengths that add up to ``total``, descending and none over ``most``, long ones first."""
        if more == 1:
            if total <= most and self.one[total]:
                yield (total,)
            return
        rest = (self.one, self.two)[more - 2]
        low = -(-total // more)
        x = np.arange(min(most, total - 1), low - 1, -1)
        for v in x[(self.one[x] > 0) & (rest[total - x] > 0)].tolist():
            for tail in self._made_of(total - v, more - 1, v):
                yield (v, *tail)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, descending; how many sequences are like that): all pieces counted are in there.

    The steps number a few for each different length, whatever the counts are: each uses a combination up.  Combinations of three may use short
    pieces up that long ones need later, so smaller combinations are tried, too, and the fewest sequences count; of equals those with the largest.
    """
    return min((filled(counts, capacity, most) for most in (3, 2, 1, 0)), key=lambda p: sum(n for _, n in p))


def filled(counts: dict[int, int], capacity: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    """Exact complements of at most ``most`` lengths, then best fit."""
    left = np.zeros(capacity + 1, np.int64)
    for x, n in counts.items():
        left[x] = n
    sums, out = Sums(left), []
    for x in range(capacity, 0, -1):
        while left[x] and (found := sums.exact(x, capacity, most)):
            times = sums.lasts(found)
            sums.take(found, times)
            out.append((found, times))
    return out + best_fit({x: int(left[x]) for x in np.flatnonzero(left).tolist()}, capacity)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest pieces first, each into the fullest sequence that has room for it; sequences with the same pieces are counted, not listed."""
    rooms: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            room = min((r for r in rooms if r >= x), default=None)
            if room is None:
                each = min(capacity // x, n)
                rooms[capacity - each * x][(x,) * each] += n // each
                n %= each
                continue
            held = next(iter(rooms[room]))
            have = rooms[room].pop(held)
            if not rooms[room]:
                del rooms[room]
            each = min(room // x, n)
            used = min(have, n // each)
            if have > used:
                rooms[room][held] += have - used
            rooms[room - each * x][held + (x,) * each] += used
            n -= used * each
    return [(held, n) for group in rooms.values() for held, n in group.items()]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: (first rank, first sequence, pieces of that length in a sequence, where they begin there), ascending by rank."""
    sequence, ranks, rows = 0, defaultdict(int), defaultdict(list)
    for lengths, times in patterns:
        at = 0
        for x in sorted(set(lengths), reverse=True):
            each = lengths.count(x)
            rows[x].append((ranks[x], sequence, each, at))
            ranks[x] += each * times
            at += each * x
        sequence += times
    return {x: tuple(np.array(v, np.int64).T) for x, v in rows.items()}


def pieces(docs: DataFrame, spec: str, capacity: int, separator: int) -> DataFrame:
    """(uid, doc_id, piece, start, length, ids_crc32): uid tells rows apart."""

    def run(batches):
        stream, held, chars = Stream(spec), [], 0

        def flush():
            uid, doc, number, start, length, crc = ([] for _ in range(6))
            ids, ends = stream.ids([t for _, _, t in held])
            before = 0
            for (u, d, _), end in zip(held, ends.tolist(), strict=True):
                raw = memoryview(ids[before:end].tobytes() + separator.to_bytes(4, "little"))
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    uid.append(u)
                    doc.append(d)
                    number.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                before = end
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip((uid, doc, number, start, length, crc), types, strict=True)], schema=types)

        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.texts(batch), strict=True):
                held.append(row)
                chars += len(row[2])
                if chars > CHARS:
                    yield flush()
                    chars = 0
        if held:
            yield flush()
        del stream
        common.released()

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(common.BATCH_ROWS))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ddl = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
    types = common.pa_schema(ddl)
    return rows.mapInArrow(run, ddl)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, separator: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of docs."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    rows = common.stored(pieces(docs, spec, capacity, separator), "pieces")
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most ``capacity`` rows
    sent = docs.sparkSession.sparkContext.broadcast(places(plan(counts, capacity)))
    # The rank of a piece among those of its length: within a bucket, and the buckets before it.  The most frequent length has about as many buckets as
    # rows in each of them, so a length that a third of all pieces share is in no task's way.
    buckets = max(1, math.isqrt(max(counts.values(), default=1)))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("uid", "piece"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("uid", "piece")
    ranked = dealt.withColumn("within", F.row_number().over(within)).join(before, ["length", "bucket"])

    def make():
        table = sent.value

        def of(batch):
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            length, rank = col["length"].to_numpy(), col["rank"].to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length).tolist():
                own = np.flatnonzero(length == x)
                first, begin, each, at = table[x]
                k = np.searchsorted(first, rank[own], "right") - 1
                nth = rank[own] - first[k]
                sequence[own] = begin[k] + nth // each[k]
                offset[own] = at[k] + nth % each[k] * x
            return {n: col[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": sequence, "offset": offset}

        return of

    ready = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within") - 1).alias("rank"))
    return common.arrow_map(ready, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", make, rows=10_000)
