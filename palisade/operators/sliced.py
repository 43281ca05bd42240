"""Greedy thresholds of keys that hold very many events, dealt to all tasks by slices of time.

"The next hit after this one" is a function on a key's events: the first event that completes a window of events not used before.  So the hits
are one path through that function, from the key's beginning.  A slice, which is a window long at least and brings the window before it along,
works its part of the function out and follows it from every place where the path may come in, by pointer doubling; where the path goes out is all
that it tells.  Those tables, some numbers for each slice, are put together in order of time; then each slice walks its part of the path alone.
The hits that fire are such a path among the hits: the next one is the first that is not in the quiet time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: About as many rows of a key are one slice; where events come close together a slice has those of one window.
ROWS = 200_000
_TABLE = "hid int, slice long, `from` array<long>, `to` array<long>, halo long, own long"


def runs(batches, keys: int) -> Iterator[tuple[tuple, list[pa.ChunkedArray]]]:
    """Rows that come sorted by the first ``keys`` columns, in groups of equal ones, with the other columns."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(i)) for i in range(keys)]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], 0)) + 1
        for a, b in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows], strict=True):
            now = tuple(c[a].item() for c in cols)
            if now != at and held:
                yield at, pa.Table.from_batches(held).columns[keys:]
                held = []
            at = now
            held.append(batch.slice(a, b - a))
    if held:
        yield at, pa.Table.from_batches(held).columns[keys:]


class Path:
    """Candidates in order; from state x the path goes on at the first one whose ``need`` is over x, and is in state ``after`` then."""

    def __init__(self, need: np.ndarray, after: np.ndarray):
        self.need, self.after = need, after
        self.next = np.searchsorted(need, after, "right")
        n = len(need)
        # The last candidate of the path from each one: jumps are doubled until none goes on.
        self.last = np.where(self.next < n, self.next, np.arange(n))
        while n and (self.next[self.last] < n).any():
            self.last = self.last[self.last]

    def enter(self, state: np.ndarray | int) -> np.ndarray:
        return np.searchsorted(self.need, state, "right")

    def walk(self, state: int) -> list[int]:
        out, k = [], int(self.enter(state))
        while k < len(self.need):
            out.append(k)
            k = int(self.next[k])
        return out


def _windows(us: np.ndarray, values: list | None, halo: int, count: int, width: int) -> tuple[np.ndarray, Path]:
    """Places of the events that can be hits, and the path over them; a state is the place of the last event that is used up."""
    m = len(us)
    if values is None:
        first = np.arange(m) - (count - 1)
    else:
        first, last = np.full(m, -1), {}
        for j, v in enumerate(values):
            last.pop(v, None)
            last[v] = j
            if len(last) >= count:
                first[j] = last[next(islice(reversed(last), count - 1, None))]
    place = np.arange(halo, m)
    ok = (first[halo:] >= 0) & (us[halo:] - us[np.maximum(first[halo:], 0)] <= width)
    return place[ok], Path(first[halo:][ok], place[ok])


def _told(start: np.ndarray, out: np.ndarray) -> tuple[list[int], list[int]]:
    """The step function start -> out, each step once, by its least start."""
    new = np.concatenate([[True], out[1:] != out[:-1]])
    return start[new].tolist(), out[new].tolist()


def _rows(cols: list[list], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, schema, strict=True)], [n for n, _ in schema])


_TABLE_TYPES = [("hid", pa.int32()), ("slice", pa.int64()), ("from", pa.list_(pa.int64())), ("to", pa.list_(pa.int64())), ("halo", pa.int64()), ("own", pa.int64())]
_ENTRY_TYPES = [("hid", pa.int32()), ("slice", pa.int64()), ("entry", pa.int64()), ("before", pa.int64())]


def _passes(dealt: DataFrame, order: list[str], table: Callable, scan: Callable, emit: Callable, made: list[tuple[str, pa.DataType]], ddl: str) -> DataFrame:
    """Tables of all slices, each slice's entry from those of its key in order, then what each slice finds from its entry."""
    rows = dealt.repartition("hid", "slice")

    def tell(batches):
        for (hid, at), cols in runs(batches, 2):
            (start, to), halo = table(cols)
            if own := len(cols[0]) - halo:
                yield _rows([[hid], [at], [start], [to], [halo], [own]], _TABLE_TYPES)

    def chain(batches):
        key, step, seen = None, None, 0
        for batch in batches:
            out = []
            for hid, at, start, to, halo, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if hid != key:
                    key, step, seen = hid, scan(), 0
                out.append((hid, at, step(at, start, to, halo), seen))
                seen += own
            if out:
                yield _rows(list(zip(*out, strict=True)), _ENTRY_TYPES)

    def find(batches):
        for (hid, _, entry, before), cols in runs(batches, 4):
            found = emit(entry, before, cols)
            yield _rows([[hid] * len(found[0]), *found], made)

    tables = rows.sortWithinPartitions("hid", "slice", *order).mapInArrow(tell, _TABLE)
    entries = tables.repartition("hid").sortWithinPartitions("hid", "slice").mapInArrow(chain, "hid int, slice long, entry long, before long")
    rest = [c for c in dealt.columns if c not in ("hid", "slice")]
    return rows.join(entries, ["hid", "slice"]).select("hid", "slice", "entry", "before", *rest).sortWithinPartitions("hid", "slice", *order).mapInArrow(find, ddl)


def hits(rows: DataFrame, count: int, width: int, distinct: bool) -> DataFrame:
    """(hid, us, rn) of the hits of rows (hid, us, o, v, lo, n, hi): ``hid`` numbers the keys, n rows of a key lie between lo and hi; rn is the hit's number among them."""
    length = F.greatest(F.lit(max(1, width)), F.ceil((F.col("hi") - F.col("lo") + 1) * F.least(F.lit(1.0), F.lit(float(ROWS)) / F.col("n"))).cast("long"))
    cut = rows.withColumn("__length", length).withColumn("slice", F.call_function("div", F.col("us") - F.col("lo"), F.col("__length")))
    # An event is also told to the next slice if that may look back to it.
    late = F.col("us") >= F.col("lo") + (F.col("slice") + 1) * F.col("__length") - width
    both = cut.withColumn("s", F.explode(F.array_compact(F.array(F.struct(F.col("slice").alias("at"), F.lit(1).alias("own")), F.when(late, F.struct((F.col("slice") + 1).alias("at"), F.lit(0).alias("own")))))))
    dealt = both.select("hid", F.col("s.at").alias("slice"), "us", "o", F.col("s.own").alias("own"), *(["v"] if distinct else []))

    def path(cols):
        us, own = cols[0].to_numpy(), cols[2].to_numpy()
        halo = int((own == 0).sum())
        return us, halo, *_windows(us, cols[3].to_pylist() if distinct else None, halo, count, width)

    def table(cols):
        us, halo, place, p = path(cols)
        if not len(place):
            return ([0], [-1]), halo
        unused = np.arange(halo + 1)  # of the halo's events, the last so many are not used up
        k = p.enter(halo - unused - 1)
        left = np.where(k < len(place), len(us) - 1 - place[p.last[np.minimum(k, len(place) - 1)]], -1)
        return _told(unused, left), halo

    def scan():
        before, left = None, -1

        def step(at, start, to, halo):
            nonlocal before, left
            entry = halo if before != at - 1 or left < 0 else min(left, halo)
            # The events after the last hit are unused; with no hit at all, those of this slice are.
            before, left = at, to[int(np.searchsorted(start, entry, "right")) - 1]
            return entry

        return step

    def emit(entry, before, cols):
        us, halo, place, p = path(cols)
        at = place[p.walk(halo - entry - 1)]
        return [us[at].tolist(), (before + 1 + at - halo).tolist()]

    made = [("hid", pa.int32()), ("us", pa.int64()), ("rn", pa.int64())]
    return _passes(dealt, ["us", "o"], table, scan, emit, made, "hid int, us long, rn long")


def fired(found: DataFrame, quiet: int) -> DataFrame:
    """(hid, us, rn, fired) of hits (hid, us, rn, lo, n, hi)."""
    if quiet <= 0:
        return found.select("hid", "us", "rn", F.lit(True).alias("fired"))
    length = F.greatest(F.lit(max(1, quiet)), F.ceil((F.col("hi") - F.col("lo") + 1) * F.least(F.lit(1.0), F.lit(float(ROWS)) / F.col("n"))).cast("long"))
    dealt = found.withColumn("slice", F.call_function("div", F.col("us") - F.col("lo"), length)).select("hid", "slice", "us", "rn")

    def table(cols):
        us = cols[0].to_numpy()
        p = Path(us, us + quiet - 1)  # a state: the last moment of quiet
        # The path comes in at a hit of the first quiet time, or at the first one after it.
        first = us[: int(np.searchsorted(us, us[0] + quiet, "left")) + 1]
        k = np.arange(len(first) + 1)
        out = np.where(k < len(us), us[p.last[np.minimum(k, len(us) - 1)]] + quiet - 1, -1)
        start = np.concatenate([[np.iinfo(np.int64).min], first])
        return _told(start, out), 0

    def scan():
        state = np.iinfo(np.int64).min

        def step(at, start, to, halo):
            nonlocal state
            entry = state
            to_here = to[int(np.searchsorted(start, state, "right")) - 1]
            state = to_here if to_here >= 0 else state
            return int(entry)

        return step

    def emit(entry, before, cols):
        us = cols[0].to_numpy()
        flags = np.zeros(len(us), bool)
        flags[Path(us, us + quiet - 1).walk(entry)] = True
        return [us.tolist(), cols[1].to_pylist(), flags.tolist()]

    made = [("hid", pa.int32()), ("us", pa.int64()), ("rn", pa.int64()), ("fired", pa.bool_())]
    return _passes(dealt, ["rn"], table, scan, emit, made, "hid int, us long, rn long, fired boolean")
