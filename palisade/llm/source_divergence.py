"""Source divergence audit: how far apart a language's sources are in their words, and which words set each one off.

Each task counts its terms in byte tries, one a language, with counters for each source at the leaves.  A trie branches on a term's first bytes; what lies
below such a prefix is one container, which is told by itself.  So tries are merged prefix by prefix, each by some task, and
traversed in UTF-8 order, leaf after leaf.  The traversal gives two things: each source's candidates, and what the terms that two sources share
add to the pair's divergence.

The divergence of a pair sums over all kept terms, though most terms are missing from most sources.  f(p, q) is split by the values p0 and q0
of missing terms:  V f(p0, q0) + sum over a's terms of (f(p, q0) - f(p0, q0)) + the same for b's
+ sum over shared terms of (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)).  The second needs only how many of a's terms have each count; only the
last looks at terms, and only at those that both have.

All arithmetic is in whole numbers; counts up to 9e15 do not overflow.

Cases: a null text, language or source is an empty one.  A row without terms makes its source occur.  Equal rows, and rows without an id, all
count.  An empty table gives an empty table.  Extra columns are left aside.
"""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SCALE = 1_000_000_000
#: Different (language, source, term) that a task counts before its tries are told.
TOLD = 600_000
#: Bytes of a prefix, and of one that begins with a letter beyond ASCII.
ASCII_PREFIX, PREFIX = 3, 4
#: Terms that are looked at together, and sources of a block of them.
TERMS, SOURCES = 2048, 128
# Bytes of terms, with capitals as small letters; all others are spaces.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


class Trie:
    """The terms of one language in a byte trie: it branches on a term's first bytes, and below each such prefix the terms are in one container,
    with a counter of occurrences and one of documents for each source.

    Tries are merged prefix by prefix, as a container is told by itself; its terms are walked in byte order.
    """

    def __init__(self):
        #: By source: occurrences and documents of each term.
        self.leaves: dict[str, tuple[Counter, Counter]] = {}

    def add(self, source: str, words: list[bytes]) -> None:
        """The words of one document."""
        if source not in self.leaves:
            self.leaves[source] = Counter(), Counter()
        n, docs = self.leaves[source]
        n.update(words)
        docs.update(set(words))

    def size(self) -> int:
        return sum(len(n) for n, _ in self.leaves.values())

    def containers(self):
        """(prefix, {source: (terms, occurrences, documents)}) of all containers."""
        out: dict[bytes, dict] = defaultdict(dict)
        for source, (n, docs) in self.leaves.items():
            below: dict[bytes, list[bytes]] = defaultdict(list)
            for w in n:
                below[w[: ASCII_PREFIX if w[0] < 128 else PREFIX]].append(w)
            for prefix, words in below.items():
                k = len(words)
                out[prefix][source] = b" ".join(words), np.fromiter(map(n.__getitem__, words), np.int64, k).tobytes(), np.fromiter(map(docs.__getitem__, words), np.int64, k).tobytes()
        return out.items()

    def merge(self, container: dict) -> None:
        for source, (words, n, docs) in container.items():
            if source not in self.leaves:
                self.leaves[source] = Counter(), Counter()
            for counter, more in zip(self.leaves[source], (n, docs), strict=True):
                get = counter.get
                for w, k in zip(words.split(b" "), np.frombuffer(more, np.int64).tolist(), strict=True):
                    counter[w] = get(w, 0) + k

    def walk(self, least_docs: int):
        """(term, documents, sources, occurrences) in byte order, of terms in ``least_docs`` documents or more."""
        total: Counter = Counter()
        for _, docs in self.leaves.values():
            total.update(docs)
        for w in sorted(w for w, d in total.items() if d >= least_docs):
            own = [(s, n[w]) for s, (n, _) in self.leaves.items() if w in n]
            yield w.decode(), total[w], [s for s, _ in own], [k for _, k in own]


def count_tries(docs: DataFrame) -> DataFrame:
    """(lang, prefix, container, sources): the containers of each task's tries; a row without a prefix tells all sources of a language."""
    types = pa.schema([("lang", pa.string()), ("prefix", pa.binary()), ("container", pa.binary()), ("sources", pa.list_(pa.string()))])

    def run(batches):
        tries: dict[str, Trie] = defaultdict(Trie)

        def flush():
            yield _told([(lang, None, None, [*t.leaves]) for lang, t in tries.items()], types)
            for lang in list(tries):
                rows = [(lang, prefix, pickle.dumps(c), None) for prefix, c in tries.pop(lang).containers()]
                for i in range(0, len(rows), 2000):
                    yield _told(rows[i : i + 2000], types)

        for batch in batches:
            for t, lang, source in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                tries[lang].add(source, t.translate(_TABLE).split())
            if sum(t.size() for t in tries.values()) > TOLD:
                yield from flush()
        if tries:
            yield from flush()
        common.released()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(common.BATCH_ROWS))
    return docs.select(text("text").cast("binary").alias("text"), text("lang").alias("lang"), text("source").alias("source")).mapInArrow(run, "lang string, prefix binary, container binary, sources array<string>")


_LEAF = "lang string, term string, docs long, sources array<string>, counts array<long>"
_LEAF_TYPES = pa.schema([("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_PAIR = "lang string, a string, b string, value long"
_PAIR_TYPES = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])


def _told(rows: list[tuple], types: pa.Schema = _LEAF_TYPES) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), types, strict=True)], schema=types)


def merged(containers: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, docs, sources, counts) of terms in ``least_docs`` documents or more: the containers of each prefix merged, and walked in byte order."""

    def run(batches):
        at, trie = None, Trie()

        def walked():
            rows = [(at[0], *x) for x in trie.walk(least_docs)]
            for i in range(0, len(rows), 5000):
                yield _told(rows[i : i + 5000])

        for batch in batches:
            for lang, prefix, container in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (lang, prefix) != at:
                    yield from walked()
                    at, trie = (lang, prefix), Trie()
                trie.merge(pickle.loads(container))
        yield from walked()
        common.released()

    rows = containers.where("prefix IS NOT NULL").select("lang", "prefix", "container")
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return rows.repartition("lang", "prefix").sortWithinPartitions("lang", "prefix").mapInArrow(run, _LEAF)


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), three digits at a time, so that no product passes 64 bits."""
    d = total + 2 * terms
    first = (count + 2) * 1000
    second = (first % d) * 1000
    third = (second % d) * 1000
    div = lambda a: F.call_function("div", a, d)
    return (1 + div(first) * 1_000_000 + div(second) * 1000 + div(third)).cast("long")


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def audit(docs: DataFrame, least_docs: int = 10, most_terms: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair``: the divergence from each other source of the language; part ``term``: the
    ``most_terms`` terms by which a source is most above its language."""
    leaves = common.stored(count_tries(docs), "containers")
    kept = common.stored(merged(leaves, least_docs), "kept-terms")
    occurring = leaves.where("prefix IS NULL").select("lang", F.explode("sources").alias("source")).distinct()
    each = kept.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", "term", F.col("x.sources").alias("source"), F.col("x.counts").alias("count"))
    # How many terms of a group have each count; N and V follow from that, for groups and languages.
    shape = common.stored(each.groupBy("lang", "source", "count").agg(F.count(F.lit(1)).alias("terms")), "shapes")
    sums = shape.groupBy("lang", "source").agg(F.sum(F.col("count") * F.col("terms")).alias("n"))
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("lang_n"))
    groups = occurring.join(sums, ["lang", "source"], "left").join(terms, "lang", "left").na.fill(0, ["n", "v", "lang_n"])
    n, v = F.col("n"), F.col("v")
    groups = common.stored(groups.withColumn("p0", F.when(v > 0, share(F.lit(0).cast("long"), n, v)).otherwise(F.lit(1).cast("long"))), "groups")

    # Terms: a group's candidates; a task keeps the first of a group before rows move.
    size = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    entries = kept.withColumn("all", size).select("lang", "term", "all", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", "term", "all", F.col("x.sources").alias("source"), F.col("x.counts").alias("count"))
    shared = common.spread_join(entries, groups.join(shape.groupBy("lang", "source").agg(F.sum("terms").alias("n_left")), ["lang", "source"]), ["lang", "source"], "inner", entries.count())
    valued = common.stored(shared.select("lang", "term", "source", share(F.col("count"), n, v).alias("p"), share(F.col("all"), F.col("lang_n"), v).alias("q"), "p0"), "shares")
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    above = valued.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    candidates = above.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most_terms)

    # Pairs: what each of the three sums gives.
    a, b = groups.select("lang", F.col("source").alias("a"), F.col("p0").alias("p0a"), "v"), groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("p0b"))
    pairs = a.join(b, "lang").where("a < b")
    base = pairs.select("lang", "a", "b", (F.col("v") * apart(F.col("p0a"), F.col("p0b"))).alias("value"))
    own = _own(shape, groups)
    both = _both(valued)
    half = base.unionByName(own).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    side = lambda x, y: half.select("lang", F.col(x).alias("source"), F.lit("pair").alias("part"), F.col(y).alias("item"), "value")
    ranked = side("a", "b").unionByName(side("b", "a")).withColumn("rank", F.row_number().over(first))
    return ranked.unionByName(candidates).select("lang", "source", "part", "item", F.col("value").cast("long"), "rank")


def _own(shape: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value): what the terms of one source of a pair add, as if the other had none of them.  A row of the work is a source
    with its counts, and a block of other sources."""
    at = groups.select("lang", "source", "n", "v", "p0")
    value = share(F.col("count"), F.col("n"), F.col("v"))
    own = shape.join(at, ["lang", "source"]).groupBy("lang", "source", "p0").agg(F.collect_list(F.struct(value.alias("p"), "terms")).alias("x"))
    number = F.pmod(F.xxhash64("source"), F.greatest(F.lit(1), F.ceil(F.col("s") / SOURCES)))
    sized = at.join(at.groupBy("lang").agg(F.count(F.lit(1)).alias("s")), "lang")
    blocks = sized.groupBy("lang", number.alias("block")).agg(F.collect_list(F.struct("source", "p0")).alias("others"))

    def make():
        def of(batch):
            lang, source, p0, x, others = (batch.column(i).to_pylist() for i in range(5))
            rows = []
            for la, s, zero, counted, block in zip(lang, source, p0, x, others, strict=True):
                q = np.array([o["p0"] for o in block], np.int64)
                total = np.zeros(len(q), np.int64)
                for i in range(0, len(counted), TERMS):
                    p = np.array([c["p"] for c in counted[i : i + TERMS]], np.int64)[:, None]
                    times = np.array([c["terms"] for c in counted[i : i + TERMS]], np.int64)[:, None]
                    total += ((_f(p, q) - _f(np.int64(zero), q)) * times).sum(0)
                rows += [(la, *sorted((s, o["source"]), key=str.encode), t) for o, t in zip(block, total.tolist(), strict=True) if o["source"] != s]
            return dict(zip(("lang", "a", "b", "value"), zip(*rows, strict=True), strict=True)) if rows else dict.fromkeys(("lang", "a", "b", "value"), [])

        return of

    return common.arrow_map(own.join(blocks, "lang").select("lang", "source", "p0", "x", "others"), _PAIR, make)


def _both(valued: DataFrame) -> DataFrame:
    """(lang, a, b, value): what the terms that both have add besides, summed within tasks."""

    def run(batches):
        sums: dict[tuple[str, str, str], int] = defaultdict(int)

        def flush():
            rows = [(*k, v) for k, v in sums.items()]
            sums.clear()
            for i in range(0, len(rows), 50_000):
                yield _told(rows[i : i + 50_000], _PAIR_TYPES)

        for batch in batches:
            for lang, rows in groupby(zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True), key=lambda r: r[0]):
                found = [r[1] for r in rows]
                zero = {e["source"]: e["p0"] for entries in found for e in entries}
                names = sorted(zero, key=str.encode)
                number = {s: i for i, s in enumerate(names)}
                row = np.repeat(np.arange(len(found)), [len(e) for e in found])
                col = np.array([number[e["source"]] for entries in found for e in entries], np.int64)
                p = np.array([e["p"] for entries in found for e in entries], np.int64)
                p0 = np.array([zero[s] for s in names], np.int64)
                for i in range(0, len(names), SOURCES):
                    for j in range(i, len(names), SOURCES):
                        left, right = (_dense(row, col, p, len(found), b, min(b + SOURCES, len(names))) for b in (i, j))
                        for k in range(left.shape[1]):
                            have = left[:, k] > 0
                            x, y = left[have, k][:, None], right[have]
                            shared, q0 = y > 0, p0[j : j + y.shape[1]]
                            y = np.where(shared, y, 1)
                            extra = np.where(shared, _f(x, y) - _f(x, q0) - _f(p0[i + k], y) + _f(p0[i + k], q0), 0).sum(0)
                            for m in np.flatnonzero(extra).tolist():
                                if j + m > i + k:
                                    sums[lang, names[i + k], names[j + m]] += int(extra[m])
                        if len(sums) > 200_000:
                            yield from flush()
        if sums:
            yield from flush()
        common.released()

    rows = valued.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("x")).select("lang", "x")
    valued.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TERMS))
    return rows.sortWithinPartitions("lang").mapInArrow(run, _PAIR)


def _dense(row: np.ndarray, col: np.ndarray, p: np.ndarray, terms: int, begin: int, end: int) -> np.ndarray:
    """Terms by the sources from begin to end; 0 where a source lacks a term."""
    own = (col >= begin) & (col < end)
    out = np.zeros((terms, end - begin), np.int64)
    out[row[own], col[own] - begin] = p[own]
    return out
