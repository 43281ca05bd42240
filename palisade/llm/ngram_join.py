"""N-gram Jaccard join by T-occurrence search (DivideSkip), spread over a cluster without losing a link.

A document is the set of its distinct word n-grams (as 64-bit hashes); two documents link when their Jaccard similarity reaches
``percent``.  Steps:

1. Equal sets are one class; its least doc_id stands for it from here on.
2. Blocks.  For sizes up to ``hi``, linked sets differ in at most H = hi * (100 - percent) / percent n-grams, so if n-grams
   are dealt by hash to H + 1 segments, one segment at least is equal in both.  Each class sends the hash of each segment;
   classes that share one meet in a bucket.  (Sets of close sizes share a size group; a set also speaks to the group below where a partner can be.
   Segments without n-grams say nothing: a few more segments are dealt, and a set with too many empty ones deals again
   with another hash; only after the last does it send empty ones.)
3. Every bucket's least member leads it.  A leader is a query against the members that have no lesser leader: a T-occurrence search over their inverted lists.  The longest
   lists are set apart, the short ones are merged by a heap, members that occur in enough of those are looked up in the
   long lists by binary probes, and those that reach the needed overlap link.  A query's members are dealt over blocks of
   bounded size, and components of the links are found.
4. Leaders whose members still lie in several components: all members but those of the largest component ask, all are asked, part against
   part, so each part of bounded weight meets the parts it has to.  Nothing is capped: a large bucket has more parts.

A block's links come back as a spanning forest of its components, so there are fewer links than members, whatever the size of a group.

Before the sets of a block travel, sketches of them do (two to four bits for an n-gram): a bit is the parity of the n-grams dealt to it, so sets
differ in at least as many n-grams as sketches in bits.  Members without a partner that this bound allows stay at home; no link is lost.

Cases: a null or empty text, or one without words, has an empty set and no link, and is its own component.  With fewer than n
words the whole sequence is the one n-gram.  Rows that share a doc_id are one document with the links of each of its texts; of rows
without a doc_id each text is a document of its own (named by a 64-bit hash), and its component is the least doc_id that it links with, or null.  An empty table gives an empty table.  Extra columns are left aside.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

BLOCK = 256
#: N-grams of a part of a bucket in step 4.
BLOCK_GRAMS = 1_000_000
SEEDS = 6
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct n-gram hashes of whole texts; words are hashed once as long as they are remembered."""

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()  # bytes: A-Z only are lowered, 0x20 and 0x09 to 0x0D only split
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > 250_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(words))
        out = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
        return np.unique(out)


class Segments:
    """The signatures by which sets of a similarity of ``percent`` or more meet; see step 2 above."""

    def __init__(self, percent: int):
        self.percent, self.hi = percent, [0]
        while self.hi[-1] < 1 << 40:
            self.hi.append(max(self.hi[-1] + 1, (self.hi[-1] + 1) * 10_000 // percent**2))
        self.plan: dict[int, tuple[int, int]] = {}

    def dealt(self, group: int) -> tuple[int, int]:
        """Segments of a size group, and how many of them may be empty."""
        if group not in self.plan:
            h = self.hi[group] * (100 - self.percent) // self.percent
            extra, least = 0, (self.hi[group - 1] + 1) * self.percent / 100
            if h > 8:
                for _ in range(4):
                    empty = (h + 1 + extra) * np.exp(-least / (h + 1 + extra))
                    extra = int(np.ceil(empty + 2 * np.sqrt(empty)))
            self.plan[group] = h + 1 + extra, extra
        return self.plan[group]

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        if not len(grams):
            return np.zeros(0, np.uint64)
        own = int(np.searchsorted(self.hi, len(grams)))
        groups = [own] + ([own - 1] if own > 1 and len(grams) * self.percent <= self.hi[own - 1] * 100 else [])
        out = []
        for g in groups:
            m, extra = self.dealt(g)
            for seed in range(SEEDS):
                x = mix(grams + np.uint64(seed * 0x9E3779B97F4A7C15 & _MASK))
                seg = (x >> np.uint64(32)) % np.uint64(m)
                order = np.argsort(seg, kind="stable")
                at, first = np.unique(seg[order], return_index=True)
                head = np.uint64((g * SEEDS + seed) * 0xD6E8FEB86659FD93 & _MASK)
                out.append(mix(mix(np.add.reduceat(mix(x[order]), first)) + at * np.uint64(0xA24BAED4963EE407) + head))
                if m - len(at) <= extra:
                    break
            else:
                out.append(mix(np.setdiff1d(np.arange(m, dtype=np.uint64), at) * np.uint64(0xA24BAED4963EE407) + head))
        return np.concatenate(out)


def needed(a, b, percent: int):
    """The least overlap of sets of sizes a and b whose Jaccard similarity reaches percent."""
    return -(-percent * (a + b) // (100 + percent))


def sketch(grams: np.ndarray) -> np.ndarray:
    """Parities of the n-grams over a power of two of bits, two for an n-gram at least; halves added by xor give the sketch of half as many bits."""
    bits = max(64, 1 << (2 * len(grams) - 1).bit_length()) if len(grams) else 64
    at = (mix(grams ^ np.uint64(0x9E6C63D0876A9A47)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


class Sketches:
    """The sketches of a block's sets by their length."""

    def __init__(self, sketches: list[np.ndarray], sizes: np.ndarray):
        self.own, self.sizes = sketches, sizes
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in {len(x) for x in sketches}:
            who = [i for i, x in enumerate(sketches) if len(x) == n]
            self.at[n] = np.array(who), np.stack([sketches[i] for i in who])

    @staticmethod
    def folded(x: np.ndarray, n: int) -> np.ndarray:
        while x.shape[-1] > n:
            half = x.shape[-1] // 2
            x = x[..., :half] ^ x[..., half:]
        return x

    def partners(self, i: int, percent: int) -> np.ndarray:
        """Members whose set may reach the similarity; of two sketches the longer is folded to the other's length."""
        q, size, out = self.own[i], self.sizes[i], []
        for n, (who, rows) in self.at.items():
            fit = 100 * np.minimum(self.sizes[who], size) >= percent * np.maximum(self.sizes[who], size)
            if not fit.any():
                continue
            who, rows = who[fit], rows[fit]
            differ = np.bitwise_count(self.folded(rows, len(q)) ^ self.folded(q, n)).sum(axis=1, dtype=np.int64)
            both = self.sizes[who] + size
            out.append(who[both - differ >= 2 * needed(self.sizes[who], size, percent)])
        return np.concatenate(out) if out else np.zeros(0, np.int64)


class Index:
    """Inverted lists of a block's sets: for each n-gram, the ascending members that hold it."""

    def __init__(self, members: list[np.ndarray]):
        self.sizes = np.array([len(m) for m in members], np.int64)
        grams = np.concatenate(members) if members else np.zeros(0, np.uint64)
        order = np.argsort(grams, kind="stable")
        self.members = np.repeat(np.arange(len(members)), self.sizes)[order]
        self.grams, first = np.unique(grams[order], return_index=True)
        self.ends = np.append(first, len(grams))

    def lists(self, query: np.ndarray) -> list[np.ndarray]:
        """The non-empty lists of the query's n-grams, shortest first."""
        at = np.searchsorted(self.grams, query)
        at = at[(at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] == query)] if len(self.grams) else at[:0]
        at = at[np.argsort(self.ends[at + 1] - self.ends[at], kind="stable")]
        return [self.members[a:b] for a, b in zip(self.ends[at].tolist(), self.ends[at + 1].tolist(), strict=True)]


def divide_skip(query: np.ndarray, index: Index, percent: int, weight: float = 0.03) -> list[int]:
    """Members whose overlap with the query makes their Jaccard similarity reach percent.

    With the n_long longest lists set apart, a member of overlap T is in at least T - n_long of the others.  If T - 1 lists can
    be set apart so that few entries are left, they are; otherwise their number balances merging and probing.
    """
    found, q = index.lists(query), len(query)
    fit = (100 * np.minimum(index.sizes, q) >= percent * np.maximum(index.sizes, q)) & (index.sizes > 0)
    if not found or not fit.any():
        return []
    least = needed(q, int(index.sizes[fit].min()), percent)
    if len(found) < least:
        return []
    n_long = least - 1
    if sum(map(len, found[: len(found) - n_long])) > 4 * len(found):
        n_long = min(n_long, int(least / (weight * np.log2(len(found[-1]) + 1) + 1)))
    short, long = found[: len(found) - n_long], found[len(found) - n_long :]
    at, seen, who, often = -1, 0, [], []
    for m in heapq.merge(*[p.tolist() for p in short], [len(index.sizes)]):
        if m == at:
            seen += 1
            continue
        if at >= 0 and seen >= least - n_long and fit[at]:
            who.append(at)
            often.append(seen)
        at, seen = m, 1
    return _probe(np.array(who, np.int64), np.array(often, np.int64), long, needed(q, index.sizes[who], percent))


def _probe(who: np.ndarray, seen: np.ndarray, long: list[np.ndarray], need: np.ndarray) -> list[int]:
    """Looks the candidates up in the long lists by binary search, all that are still undecided at once."""
    out: list[int] = []
    for i in range(0, len(long), 16):
        done = seen >= need
        out += who[done].tolist()
        left = ~done & (seen + len(long) - i >= need)
        who, seen, need = who[left], seen[left], need[left]
        if not len(who):
            break
        for p in long[i : i + 16]:
            at = np.searchsorted(p, who)
            seen += p[np.minimum(at, len(p) - 1)] == who
    return out + who[seen >= need].tolist()


def named(docs: DataFrame) -> DataFrame:
    """(d, text, no_id): d is the doc_id, or a hash of the text where there is none."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("d"), text.alias("text"), F.col("doc_id").cast("long").isNull().alias("no_id"))


def described(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(d, no_id, n_shingles, f1, f2, sigs, sketch): each row's id, set size, 128-bit id of the set, signatures, and sketch."""

    def make():
        shingle, segments = Shingler(n), Segments(percent)

        def of(batch):
            sets = [shingle(t) for t in common.texts(batch)]
            ids = [xxhash.xxh128_digest(s.tobytes()) for s in sets]
            f = np.frombuffer(b"".join(ids), np.int64).reshape(-1, 2)
            return {"d": batch.column(0), "no_id": batch.column(2), "n_shingles": [len(s) for s in sets], "f1": f[:, 0], "f2": f[:, 1], "sigs": [segments(s).view(np.int64) for s in sets], "sketch": [sketch(s).tobytes() for s in sets]}

        return of

    return common.arrow_map(named(docs), "d long, no_id boolean, n_shingles long, f1 long, f2 long, sigs array<long>, sketch binary", make)


def sets_of(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(d, grams binary) for the rows of docs whose id is among ids (column d)."""

    def make():
        shingle = Shingler(n)

        def of(batch):
            return {"d": batch.column(0), "grams": [shingle(t).tobytes() for t in common.texts(batch)]}

        return of

    rows = named(docs).join(ids, "d", "left_semi")
    return common.arrow_map(rows, "d long, grams binary", make)


def _groups(batches) -> Iterator[list[tuple]]:
    """Rows of one (k1, k2, k3) after the other, from batches that are sorted by them."""
    key, rows = None, []
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for row in zip(*cols, strict=True):
            if row[:3] != key:
                if rows:
                    yield rows
                key, rows = row[:3], []
            rows.append(row)
    if rows:
        yield rows


_SEEN = "k1 long, k2 long, k3 long, side int, d long, c long"


def likely(blocks: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those rows of blocks (k1, k2, k3, side, d, c) that may link with one of the other side of their block by the sketches (d, n_shingles, sketch)."""
    dealt = blocks.join(sketches, "d").select("k1", "k2", "k3", "side", "d", "c", "n_shingles", "sketch")
    dealt = dealt.repartition("k1", "k2", "k3").sortWithinPartitions("k1", "k2", "k3", "side", "d")
    types = common.pa_schema(_SEEN)

    def run(batches):
        for rows in _groups(batches):
            side, c = np.array([r[3] for r in rows]), np.array([r[5] for r in rows], np.int64)
            known = Sketches([np.frombuffer(r[7], np.uint64) for r in rows], np.array([r[6] for r in rows], np.int64))
            stays = np.zeros(len(rows), bool)
            for i in np.flatnonzero(side == 0).tolist():
                j = known.partners(i, percent)
                j = j[(side[j] == 1) & (c[j] != c[i])]
                stays[j] = True
                stays[i] |= len(j) > 0
            if stays.any():
                kept = dict.fromkeys(rows[i][:6] for i in np.flatnonzero(stays).tolist())
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*kept, strict=True), types, strict=True)], schema=types)
        common.released()

    dealt.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(common.BATCH_ROWS))
    return dealt.mapInArrow(run, _SEEN)


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


class Forest:
    """Union-find of the components that meet in a block."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether the two were apart."""
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def search(blocks: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of components within blocks (k1, k2, k3, side, d, c, grams): rows of side 0 query the rows of side 1.

    A block is small by the way it is dealt, and the rows of a block stand together: Spark partitions by the block's key
    and sorts within the partitions.  Of a block's links those stay that join what its other ones leave apart.
    """
    dealt = blocks.repartition("k1", "k2", "k3").sortWithinPartitions("k1", "k2", "k3", "side", "d")

    def run(batches):
        for rows in _groups(batches):
            asked, told = [r for r in rows if r[3] == 0], [r for r in rows if r[3] == 1]
            index, forest = Index([np.frombuffer(r[6], np.uint64) for r in told]), Forest()
            links = [(r[5], told[j][5]) for r in asked for j in divide_skip(np.frombuffer(r[6], np.uint64), index, percent) if forest.join(r[5], told[j][5])]
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_LINK)
        common.released()

    dealt.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(common.BATCH_ROWS))
    return dealt.select("k1", "k2", "k3", "side", "d", "c", "grams").mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs."""
    full = common.stored(described(docs, n, percent), "shingles")
    total = full.count()
    classes = common.stored(full.where("n_shingles > 0").groupBy("f1", "f2").agg(F.min(F.struct("no_id", "d")).alias("r"), F.count(F.lit(1)).alias("n_left")).select("f1", "f2", F.col("r.d").alias("rep"), F.col("r.no_id").alias("no_id"), "n_left"), "classes")
    # One row stands for a class, whatever number of rows has its id.
    reps = full.join(classes.select(F.col("f1"), F.col("f2"), F.col("rep").alias("d")), ["f1", "f2", "d"], "left_semi").dropDuplicates(["f1", "f2"])
    sketches = common.stored(reps.select("d", "n_shingles", "sketch"), "sketches")
    reps = common.stored(reps.select("d", "sigs"), "reps")
    rows = common.stored(full.drop("sigs", "sketch"), "rows")
    common.unstore(full)
    sent = reps.select("d", F.explode("sigs").alias("sig"))
    buckets = sent.groupBy("sig").agg(F.min("d").alias("leader"), F.count(F.lit(1)).alias("n_left")).where("n_left > 1")
    buckets = common.stored(buckets, "buckets")
    # Buckets with one leader act as one from here on: a member stands once under each leader that it meets.
    met = common.stored(common.spread_join(sent, buckets, ["sig"], "inner", total).select("leader", "d").distinct(), "met")
    common.unstore(reps)
    common.unstore(buckets)

    def linked(blocks: DataFrame, name: str) -> DataFrame:
        near = common.stored(likely(blocks, sketches, percent), "likely")
        sets = common.stored(sets_of(docs, near.select("d").distinct(), n), "sets")
        links = common.stored(search(near.join(sets, "d").select("k1", "k2", "k3", "side", "d", "c", "grams"), percent), name)
        common.unstore(near)
        common.unstore(sets)
        return links

    # Step 3: the least leader that a member meets anywhere asks for it, in blocks; so each sketch, and each set at most, travels once here.
    first = met.where("d != leader").groupBy("d").agg(F.min("leader").alias("leader")).select("leader", "d")
    deal = F.pmod(F.xxhash64("d"), F.greatest(F.lit(1), F.ceil(F.col("n_left") / BLOCK)))
    sized = common.spread_join(first, first.groupBy("leader").agg(F.count(F.lit(1)).alias("n_left")), ["leader"], "inner", total).withColumn("k2", deal.cast("long"))
    asked = sized.select("leader", "k2").distinct().select("leader", "k2", F.lit(0).alias("side"), F.col("leader").alias("d"))
    told = sized.select("leader", "k2", F.lit(1).alias("side"), "d")
    links = linked(asked.union(told).select(F.col("leader").alias("k1"), "k2", F.lit(0).cast("long").alias("k3"), "side", "d", F.col("d").alias("c")), "links")
    found = components(links)
    label = classes.join(found, classes.rep == found.node, "left").select("f1", "f2", "n_left", "no_id", "rep", F.coalesce("component", "rep").alias("component"))

    # Step 4: leaders that are still in several components.
    own = met.join(sketches.groupBy("d").agg(F.sum("n_shingles").alias("size")), "d")
    labelled = common.stored(own.join(found, own.d == found.node, "left").select("leader", "d", "size", F.coalesce("component", "d").alias("c")), "labelled")
    common.unstore(met)
    parts = labelled.groupBy("leader", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    most = F.max(F.struct("size", "c", "n"))
    open_ = parts.groupBy("leader").agg(most.alias("most"), F.sum("size").alias("size"), F.sum("n").alias("n_left"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    weigh = lambda c: F.ceil(c / BLOCK_GRAMS).cast("long")
    open_ = open_.select("leader", "n_left", F.col("most.c").alias("most"), weigh(F.col("size") - F.col("most.size")).alias("askers"), weigh(F.col("size")).alias("all"))
    members = common.stored(common.spread_join(labelled, open_, ["leader"], "inner", total).drop("n_left"), "open")
    common.unstore(labelled)
    if members.limit(1).count():
        upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        part = lambda c: F.pmod(F.xxhash64("d"), F.col(c))
        asks = members.where("c != most").select(F.col("leader").alias("k1"), part("askers").alias("k2"), upto("all").alias("k3"), F.lit(0).alias("side"), "d", "c")
        told = members.select(F.col("leader").alias("k1"), upto("askers").alias("k2"), part("all").alias("k3"), F.lit(1).alias("side"), "d", "c")
        more = linked(asks.union(told), "links")
        if more.limit(1).count():
            # Components of components: the least id of the least one.
            label = common.stored(label, "label")
            sizes = label.groupBy(F.col("component").alias("node")).agg(F.count(F.lit(1)).alias("n"))
            again = components(more).join(sizes, "node").select(F.col("node").alias("component"), F.col("component").alias("least"), F.col("n").alias("n_left"))
            label = common.spread_join(label.withColumnRenamed("n_left", "n"), again, ["component"], "left", total).select("f1", "f2", F.col("n").alias("n_left"), "no_id", "rep", F.coalesce("least", "component").alias("component"))
    if classes.where("no_id").limit(1).count():
        # The least node may be one without a doc_id: the least real one names the component.
        label = common.stored(label, "label")
        least = label.groupBy("component").agg(F.min(F.when(~F.col("no_id"), F.col("rep"))).alias("least"), F.count(F.lit(1)).alias("n_left"))
        label = common.spread_join(label.withColumnRenamed("n_left", "n"), least, ["component"], "inner", total).select("f1", "f2", F.col("n").alias("n_left"), F.col("least").alias("component"))
    out = common.spread_join(rows.where("n_shingles > 0"), label.select("f1", "f2", "n_left", "component"), ["f1", "f2"], "inner", total)
    real = F.when(~F.col("no_id"), F.col("d"))
    out = out.select(real.alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
    return out.union(rows.where("n_shingles = 0").select(real, "n_shingles", real))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs without the near-duplicates: of each component the row with the least doc_id stays (of equal rows with that id, each)."""
    gone = jaccard_components(docs, n, percent).where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
