"""Phrase collocations: phrases of two to four words that occur more often than their parts let expect.

Each shard of texts becomes a generalised suffix automaton of bounded depth.  Its states are found by refinement: the places where a gram ends are
split by the word in front, one depth after the other, so that each gram links to its suffix (the gram without that word) and knows how
many places it ends at; grams with the same places are one state.  Strings are spelled along the suffix links.  Counts are added up globally.

A phrase that is rare in each shard may be frequent in all.  So there are two passes: first, the hashes of all grams of all depths are
counted in a table of buckets, which is added up over all shards; a gram can only be frequent if its bucket is, and if all its parts are.
The second pass enumerates those grams by themselves, exactly: the buckets only save work.  The table has a bit for each bucket, and at most ``MOST_BUCKETS``:
that bounds what is sent to the tasks (128 MB).

Cases: a null text is empty, a null language is ``und``.  Equal rows, and rows without an id, all count.  An empty table gives an empty
table.  Extra columns are left aside.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .token_stream import Numbers

#: Words of a shard: an automaton takes some 150 bytes a word while it is made.
WORDS = 1_200_000
MOST_BUCKETS = 1 << 30
_BLOCK = 1 << 16
_END = b"."
# Separators all become the first of them, capitals small letters.
_TABLE = bytes.maketrans(b",;:!?\n\x0b\x0c\r" + bytes(range(65, 91)), _END * 9 + bytes(range(97, 123)))
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class Shard:
    """Texts of one language as one run of word numbers; 0 ends a piece."""

    def __init__(self, lang: str):
        self.lang, self.number, self.parts = lang, Numbers({_END: 0}), []

    def add(self, texts: list[bytes]) -> int:
        words = _END.join(texts).translate(_TABLE).replace(_END, b" . ").split()
        self.parts += [np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)), np.zeros(1, np.int64)]
        return len(words)

    def automaton(self, depth: int) -> SuffixAutomaton:
        return SuffixAutomaton(np.concatenate(self.parts), [*self.number], zlib.crc32(self.lang.encode()), depth)


class SuffixAutomaton:
    def __init__(self, words: np.ndarray, names: list[bytes], seed: int, depth: int):
        self.words, self.names, self.depth = words, names, depth
        self.hash = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in names), np.uint64, len(names))

    def hashes(self, before: np.ndarray | None, d: int) -> np.ndarray:
        """The hash of the gram of d words that ends at each place, from those of d - 1 words; what reaches over the beginning is any."""
        own = self.hash[self.words]
        if d == 1:
            return own
        out = before.copy()
        out[d - 1 :] ^= own[: len(own) - d + 1] * _MIX[d - 2]
        return out * _MIX[0]

    def whole(self, d: int, before: np.ndarray | None) -> np.ndarray:
        """Where a gram of d words ends: within a piece."""
        if d == 1:
            return self.words > 0
        out = np.zeros_like(before)
        out[d - 1 :] = before[d - 1 :] & (self.words[: len(out) - d + 1] > 0)
        return out

    def buckets(self, bits: int) -> np.ndarray:
        """The bucket of each gram at each place."""
        out, h, at = [], None, None
        for d in range(1, self.depth + 1):
            h, at = self.hashes(h, d), self.whole(d, at)
            out.append((h[at] >> np.uint64(64 - bits)).astype(np.uint32))
        return np.concatenate(out)

    def grams(self, bits: int, frequent: np.ndarray):
        """(words, strings, counts) by depth, of the grams that may be frequent and have only such parts."""
        h = at = below = None
        strings: list[bytes] = []
        for d in range(1, self.depth + 1):
            h, at = self.hashes(h, d), self.whole(d, at)
            bucket = h >> np.uint64(64 - bits)
            at &= (frequent[(bucket >> np.uint64(3)).astype(np.int64)] >> (7 - (bucket & np.uint64(7)).astype(np.uint8))) & 1 > 0
            if d > 1:
                at[1:] &= shorter[:-1]
                at &= shorter
            ends = np.flatnonzero(at)
            # A gram's suffix is the gram one depth before that ends at the same place; the word in front tells grams of one suffix apart.
            link = below[ends] if d > 1 else np.zeros(len(ends), np.int64)
            front = self.words[ends - d + 1]
            found, which, count = np.unique(link * len(self.names) + front, return_inverse=True, return_counts=True)
            below = np.zeros(len(at), np.int64)
            below[ends] = which
            shorter = at.copy()
            links, fronts = divmod(found, len(self.names))
            strings = [self.names[w] if d == 1 else self.names[w] + b" " + strings[k] for k, w in zip(links.tolist(), fronts.tolist(), strict=True)]
            yield d, strings, count


def _shards(batches):
    """Shards of all languages, whenever they have some words together."""
    held, n = {}, 0
    for batch in batches:
        by = defaultdict(list)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by[lang].append(text)
        for lang, texts in by.items():
            n += held.setdefault(lang, Shard(lang)).add(texts)
        if n > WORDS:
            yield [*held.values()]
            held, n = {}, 0
    if held:
        yield [*held.values()]


def _rows(docs: DataFrame) -> DataFrame:
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(common.BATCH_ROWS))
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def frequent_buckets(docs: DataFrame, bits: int, least: int, depth: int) -> np.ndarray:
    """A bit for each of 2**bits buckets: whether ``least`` grams or more fall there."""
    kind = np.min_scalar_type(least)

    def tell(batches):
        for shards in _shards(batches):
            keys, n = np.unique(np.concatenate([s.automaton(depth).buckets(bits) for s in shards]), return_counts=True)
            block, low = keys >> 16, (keys & 0xFFFF).astype(np.uint16)
            n = np.minimum(n, least).astype(kind)  # more makes no difference
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(keys)]
            for i in range(0, len(cuts) - 1, 256):
                part = [(a, b) for a, b in zip(cuts[i : i + 256], cuts[i + 1 : i + 257], strict=False) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([int(block[a]) for a, _ in part], pa.int32()), pa.array([low[a:b].tobytes() for a, b in part], pa.binary()), pa.array([n[a:b].tobytes() for a, b in part], pa.binary())], ["block", "low", "n"])
        common.released()

    def add(batches):
        size, at, total = min(_BLOCK, 1 << bits), None, None

        def bitmap():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], ["block", "bits"])

        for batch in batches:
            for block, low, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if block != at:
                    if at is not None:
                        yield bitmap()
                    at, total = block, np.zeros(size, np.int64)
                total[np.frombuffer(low, np.uint16)] += np.frombuffer(n, kind)  # a shard tells a bucket once
        if at is not None:
            yield bitmap()

    told = _rows(docs).mapInArrow(tell, "block int, low binary, n binary")
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in told.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, bits binary").collect():
        out[r["block"] * _BLOCK // 8 :][: len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def phrase_counts(docs: DataFrame, least: int, depth: int = 4) -> DataFrame:
    """(lang, size, phrase, n) of all phrases of up to ``depth`` words with n >= least; size 0: all words of the language."""
    chars = docs.select(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    bits = min(max(16, (chars // 8).bit_length()), MOST_BUCKETS.bit_length() - 1)
    sent = docs.sparkSession.sparkContext.broadcast(frequent_buckets(docs, bits, least, depth))

    def tell(batches):
        for shards in _shards(batches):
            for s in shards:
                made = s.automaton(depth)
                yield _counted(s.lang, 0, [b""], [int((made.words > 0).sum())])
                for d, strings, count in made.grams(bits, sent.value):
                    for i in range(0, len(strings), 20_000):
                        yield _counted(s.lang, d, strings[i : i + 20_000], count[i : i + 20_000])
        common.released()

    rows = _rows(docs).mapInArrow(tell, "lang string, size int, phrase string, n long")
    return rows.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("size") == 0))


def _counted(lang: str, size: int, strings: list[bytes], n) -> pa.RecordBatch:
    k = len(strings)
    return pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array(np.full(k, size, np.int32)), pa.array(strings, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "size", "phrase", "n"])


def mine(docs: DataFrame, least: int = 30, subsumed: int = 80, scale: int = 2_000_000, most: int = 2000, depth: int = 4) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``most`` phrases by score.

    a is the phrase's count, l and r those of the parts at its weakest cut, score ``floor(scale * a / (l + r))``, n all words of the language.
    A phrase goes if one that is longer holds it and has ``subsumed`` percent of its count or more.
    """
    counts = common.stored(phrase_counts(docs, least, depth), "phrases")
    words = F.split("phrase", " ", -1)
    phrases = counts.where("size > 1").withColumnRenamed("n", "a")
    # A longer phrase contains one with a word less at its suffix link, and one where it came from; those have its count at least, so to look one word ahead is enough.
    shorter = F.explode(F.array(F.array_join(F.slice("w", 2, F.col("size") - 1), " "), F.array_join(F.slice("w", 1, F.col("size") - 1), " "))).alias("phrase")
    longer = phrases.where("size > 2").withColumn("w", words).select("lang", shorter, "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = phrases.join(longer, ["lang", "phrase"], "left").where(F.expr(f"longer IS NULL OR CAST(longer AS DECIMAL(20, 0)) * 100 < CAST(a AS DECIMAL(20, 0)) * {int(subsumed)}"))
    # Both parts of each cut are looked up; a part such as a common word may be one of very many phrases'.
    cut = kept.withColumn("w", words).select("lang", "phrase", "size", "a", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    sides = F.explode(F.array(F.struct((2 * F.col("k")).alias("side"), F.array_join(F.slice("w", 1, F.col("k")), " ").alias("part")), F.struct((2 * F.col("k") + 1).alias("side"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("part"))))
    parts = common.stored(cut.select("lang", "phrase", "size", "a", sides.alias("s")).select("lang", "phrase", "size", "a", "s.side", "s.part"), "parts")
    often = parts.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n_left"))
    known = often.join(counts.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")).where("part != ''"), ["lang", "part"])
    found = common.spread_join(parts, common.stored(known, "part-counts"), ["lang", "part"], "inner", parts.count())
    by_side = found.groupBy("lang", "phrase", "size", "a").agg(F.map_from_entries(F.collect_list(F.struct("side", "f"))).alias("m"))
    cuts = by_side.withColumn("best", F.expr(f"array_min(transform(sequence(1, size - 1), k -> struct(CAST(a AS DECIMAL(20, 0)) * {int(scale)} div (m[2 * k] + m[2 * k + 1]) AS score, k AS k, m[2 * k] AS l, m[2 * k + 1] AS r)))"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    top = cuts.select("lang", "phrase", "a", "best.l", "best.r", "best.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    total = counts.where("size = 0").select("lang", "n")
    return top.join(total, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
