"""Benchmark decontamination by latent semantic retrieval.

The benchmark's passages are a TF-IDF matrix (document frequencies over the whole corpus); its leading right singular vectors come from
a distributed randomised SVD and span the latent space.  Every window of every document, at two lengths and with half of each
overlapping the next, is projected there and its cosine with each passage taken; windows above ``least_cosine`` are
candidates.  A candidate is confirmed on words: the longest common subsequence of the passage and the document around the window
must hold ``sure_share`` of the passage's words, or ``least_share`` and the answer too (an ``answer`` column of the benchmark,
else the passage's last quarter).  So reordered, shortened or slightly reworded copies are found as well as exact ones.

Windows around which ``least_share`` of every passage's words are lacking, in any order, are not projected: no subsequence there
could confirm anything, so nothing is lost by that, at any size of the corpus.  An item with fewer than LEAST_WORDS words makes no passage; it is found as
an exact phrase.

The benchmark is the query set and comes in blocks of BLOCK_WORDS words, in passages of at most PASSAGE words; that bounds the terms, and with
them everything that is broadcast or gathered on the driver: BLOCK_WORDS x (RANK + OVERSAMPLING) numbers of 4 bytes at most, 71 MB.  The
corpus is read once for document frequencies and once for each block's search; it never shuffles.

Cases: null or empty texts match nothing, on either side.  A passage that two items share gives a row for each.  Rows of docs that are equal in doc_id
give one row an item, that of their best window.  Empty tables give no rows.  Extra columns are left aside (``clean`` keeps them).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PASSAGE, BLOCK_WORDS, LEAST_WORDS = 64, 65_536, 5
SCALES = (16, 32)
STEP = 8
#: Windows that are projected together.
PIECE = 512
#: Places of passages' words that are looked at together to rule windows out.
PLACES = 1 << 18
RANK, OVERSAMPLING = 256, 16
_WORD, _NO_WORD = re.compile(r"\w").match, re.compile(r"[^\w\x00-\x7F]").sub
_SPACED = bytes(c if c > 127 or _WORD(chr(c)) else 32 for c in range(256))
_CODES = np.array([c if c < 128 or _WORD(chr(c)) else 32 for c in range(1 << 16)], "<u4")


def spaced(text: str) -> bytes:
    r"""The text in lower case and UTF-8, with a space for each character that ``\w`` does not match."""
    text = text.lower()
    if not text.isascii():
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        text = _CODES[codes].tobytes().decode("utf-32-le") if codes.max() < len(_CODES) else _NO_WORD(" ", text)
    return text.encode().translate(_SPACED)


def words_of(text: str) -> list[str]:
    return spaced(text).decode().split()


def numbered(texts: list[str], terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as places in terms, len(terms) for any other, and how many each text has; one without words has one that is no term."""
    words = pc.ascii_split_whitespace(pa.array([spaced(t).strip() for t in texts], pa.string()))
    ids = pc.index_in(words.values, value_set=terms).fill_null(len(terms))
    return ids.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(words.offsets.to_numpy())


@dataclass
class Index:
    """What the executors need for one block of passages."""

    column: dict[str, int]  # term -> row of latent
    latent: np.ndarray  # terms x rank: weight times right singular vectors
    items: list[int]
    passages: list[list[str]]
    answers: list[list[str]]
    unit: np.ndarray  # passages x rank, of length 1 each
    phrases: dict[str, list[tuple[int, list[str]]]] = field(default_factory=dict)  # short items by their first word


def passages_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, words, answer): items cut to passages of at most PASSAGE words; a short item is one."""
    has_answer = "answer" in benchmark.columns
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"), (F.col("answer").cast("string") if has_answer else F.lit(None).cast("string")).alias("answer"))

    def make():
        def of(batch):
            out = {"item_id": [], "words": [], "answer": []}
            answers = common.texts(batch, "answer")
            for i, t, a in zip(batch.column(0).to_pylist(), common.texts(batch), answers, strict=True):
                w = words_of(t)
                for k in range(0, len(w), PASSAGE):
                    p = w[max(0, min(k, len(w) - PASSAGE)) : k + PASSAGE]
                    out["item_id"].append(i)
                    out["words"].append(p)
                    out["answer"].append(words_of(a) or p[-max(3, len(p) // 4) :])
            return out

        return of

    return common.arrow_map(rows, "item_id long, words array<string>, answer array<string>", make)


def document_frequencies(docs: DataFrame, terms: dict[str, int]) -> tuple[int, np.ndarray]:
    """Number of documents, and of those that hold each term: over all rows of docs, added up in tasks first."""
    sent = docs.sparkSession.sparkContext.broadcast(list(terms))

    def run(batches):
        known = pa.array(sent.value, pa.string())
        n, df = 0, np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            if batch.num_rows:
                ids, sizes = numbered(common.texts(batch), known)
                seen = np.zeros((len(sizes), len(df)), bool)
                seen[np.arange(len(sizes)).repeat(sizes), ids] = True
                n += len(sizes)
                df += seen.sum(axis=0)
        found = np.flatnonzero(df[:-1])
        yield pa.RecordBatch.from_arrays([pa.array([*found.tolist(), -1], pa.int64()), pa.array([*df[found].tolist(), n], pa.int64())], ["c", "n"])

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(common.BATCH_ROWS))
    got = dict(docs.select(F.col("text").cast("string")).mapInArrow(run, "c long, n long").groupBy("c").agg(F.sum("n")).collect())
    return got.pop(-1, 0), np.array([got.get(c, 0) for c in range(len(terms))], float)


def randomised_svd(rows: DataFrame, n_terms: int, rank: int, seed: int = 11) -> np.ndarray:
    """Leading right singular vectors (n_terms x rank) of the sparse matrix rows(cols array<int>, vals array<double>).

    Each step multiplies a thin matrix by A^T A: every task does so for its rows, and the thin products are summed.
    """
    sc = rows.sparkSession.sparkContext

    def times_gram(q: np.ndarray) -> np.ndarray:
        sent = sc.broadcast(q.astype(np.float32))

        def make():
            def of(batch):
                acc: dict[int, np.ndarray] = {}
                for cols, vals in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    v = np.array(vals, np.float32)
                    for c, x in zip(cols, np.outer(v, v @ sent.value[cols]), strict=True):
                        acc[c] = acc[c] + x if c in acc else x
                return {"c": list(acc), "v": [x.tobytes() for x in acc.values()]}

            return of

        out = np.zeros_like(q)
        for c, v in common.arrow_map(rows, "c int, v binary", make).toLocalIterator():
            out[c] += np.frombuffer(v, np.float32)
        sent.unpersist()
        return out

    r = min(rank + OVERSAMPLING, n_terms)
    q, _ = np.linalg.qr(times_gram(np.random.default_rng(seed).standard_normal((n_terms, r))))
    for _ in range(2):
        q, _ = np.linalg.qr(times_gram(q))
    values, u = np.linalg.eigh(q.T @ times_gram(q))
    best = np.argsort(-values)[: min(rank, int((values > 1e-9 * max(values.max(), 1e-300)).sum()))]
    return q @ u[:, best]


def build_indexes(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> list[Index]:
    spark, out = docs.sparkSession, []
    rows = passages_of(benchmark)
    n_words = rows.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = -(-n_words // BLOCK_WORDS)
    for b in range(blocks):
        every = (rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == b)).collect()
        every.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        phrases: dict[str, list[tuple[int, list[str]]]] = {}
        for r in every:
            if len(r[1]) < LEAST_WORDS:
                phrases.setdefault(r[1][0], []).append((r[0], r[1]))
        part = [r for r in every if len(r[1]) >= LEAST_WORDS]
        if not part:
            if phrases:
                out.append(Index({}, np.zeros((1, 0), np.float32), [], [], [], np.zeros((0, 0), np.float32), phrases))
            continue
        column = {w: i for i, w in enumerate(sorted({w for r in part for w in r[1]}))}
        total, df = document_frequencies(docs, column)
        idf = np.log((1 + total) / (1 + df)) + 0.05
        cols = [[column[w] for w in Counter(r[1])] for r in part]
        vals = [[float(idf[column[w]] * np.sqrt(k)) for w, k in Counter(r[1]).items()] for r in part]
        matrix = spark.createDataFrame([(c, v) for c, v in zip(cols, vals, strict=True)], "cols array<int>, vals array<double>").repartition(max(1, len(part) // 64))
        v = randomised_svd(matrix, len(column), rank)
        latent = (idf[:, None] * v).astype(np.float32)
        unit = np.array([np.array(x) @ v[c] for c, x in zip(cols, vals, strict=True)], np.float32)
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
        out.append(Index(column, np.vstack([latent, np.zeros((1, v.shape[1]), np.float32)]), [r[0] for r in part], [r[1] for r in part], [r[2] for r in part], unit, phrases))
    return out


def lcs(item: dict[str, int], n: int, words: list[str]) -> int:
    """Length of the longest common subsequence, by bits: item maps a word to the bits of its places among n."""
    v = full = (1 << n) - 1
    for w in words:
        if m := item.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def bits(words: list[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each first on, n of each."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def parts(costs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges (from, to) of neighbours that cost little more than PLACES together."""
    cuts = np.flatnonzero(np.diff(np.cumsum(costs) // PLACES)) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(costs)], strict=True) if len(costs) else iter(())


class Searcher:
    def __init__(self, index: Index, least_cosine: float, least_share: float, sure_share: float):
        self.index, self.least_cosine, self.least_share, self.sure_share = index, least_cosine, least_share, sure_share
        self.bits, self.answer_bits = [bits(p) for p in index.passages], [bits(a) for a in index.answers]
        lengths = np.array([len(p) for p in index.passages], np.int64)
        self.need = least_share * lengths - 1e-9
        # No window looks at words farther before its first one, or farther after it, for a passage.
        reach = [[self.reach_of(n, scale) for scale in SCALES] for n in lengths.tolist()]
        self.left, self.right = np.array([max(r) for r in reach]), np.array([max(map(sum, zip(r, SCALES, strict=True))) for r in reach])
        # The passages' distinct words one after the other, and how often each is in its passage.
        own = [sorted(Counter(index.column[w] for w in p).items()) for p in index.passages]
        self.n_own = np.array([len(x) for x in own], np.int64)
        self.first_own = np.cumsum(self.n_own) - self.n_own
        self.own, self.times = np.array([x for words in own for x in words], np.int64).reshape(-1, 2).T
        self.terms = pa.array(list(index.column), pa.string())
        # The passages of the first word, as often as they hold it, of the second, and so on.
        word = self.own.repeat(self.times)
        self.held = np.arange(len(lengths)).repeat(lengths)[np.argsort(word, kind="stable")]
        self.n_held = np.bincount(word, minlength=len(index.column))
        self.first_held = np.cumsum(self.n_held) - self.n_held

    @staticmethod
    def reach_of(n: int, scale: int) -> int:
        """Words on either side of a window among which a passage of n words is looked for."""
        return max(0, int(1.5 * n) - scale // 2) // 2 + scale // 4

    def open_steps(self, ids: np.ndarray) -> np.ndarray:
        """For each step of STEP words, whether a window from there can be confirmed at all."""
        return self.open_steps_of(ids, np.array([len(ids)]))[0]

    def open_steps_of(self, ids: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """The open steps of several texts: those from where the words that a window looks at for a passage hold enough of its words, whatever their order."""
        other, width, steps = len(self.index.column), len(self.index.column) + 1, -(-sizes // STEP)
        out, known = np.zeros(steps.sum(), bool), np.flatnonzero(ids < other)
        text = np.arange(len(sizes)).repeat(sizes)[known]
        key = text * width + ids[known]
        order = np.argsort(key, kind="stable")
        key, place = key[order], (known - (np.cumsum(sizes) - sizes)[text])[order]
        new = np.append(True, key[1:] != key[:-1])[: len(key)]
        before = np.where(new, -(1 << 40), np.roll(place, 1))  # the place of the same word before, or one beyond reach
        # Each word of each text once: where its places begin, and how many they are.
        begins = np.flatnonzero(new)
        held, n_places, (text, word) = key[begins], np.diff(np.append(begins, len(key))), np.divmod(key[begins], width)
        passages = len(self.need)
        for a, b in parts(np.bincount(text, self.n_held[word], len(sizes))):
            own = slice(*np.searchsorted(text, (a, b)))
            n = self.n_held[word[own]]
            found = np.bincount((text[own] - a).repeat(n) * passages + self.held[ranges(self.first_held[word[own]], n)], minlength=(b - a) * passages).reshape(b - a, passages)
            rows = np.argwhere(found >= self.need) + (a, 0)
            for c, d in parts(sizes[rows[:, 0]]):
                self._open(out, rows[c:d, 0], rows[c:d, 1], (held, begins, n_places), place, before, steps)
        return np.split(out, np.cumsum(steps)[:-1])

    def _open(self, out: np.ndarray, text: np.ndarray, passage: np.ndarray, held: tuple, place: np.ndarray, before: np.ndarray, steps: np.ndarray) -> None:
        """Marks in out the open steps of these texts by these passages, pair by pair."""
        keys, begins, n_places = held
        n_own, first_step, n_steps = self.n_own[passage], (np.cumsum(steps) - steps)[text], steps[text]
        which, pair = ranges(self.first_own[passage], n_own), np.arange(len(text)).repeat(n_own)
        wanted = text[pair] * (len(self.index.column) + 1) + self.own[which]
        found = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
        there = np.flatnonzero(keys[found] == wanted) if len(keys) else found[:0]
        found = found[there]
        n = n_places[found]
        at, pair, times = ranges(begins[found], n), pair[there].repeat(n), self.times[which[there]].repeat(n)
        # A place counts for the steps that look at it, and at no earlier place of its word.
        place, before, left, right = place[at], before[at], self.left[passage][pair], self.right[passage][pair]
        end = np.minimum((place + left) // STEP + 1, n_steps[pair])
        begin = np.minimum(np.maximum(np.maximum(place - right, before + left) // STEP + 1, 0), end)
        cells = n_steps + 1
        first = np.cumsum(cells) - cells
        base, total = first[pair], cells.sum()
        enough = (np.bincount(base + begin, times, total) - np.bincount(base + end, times, total)).cumsum() >= self.need[passage].repeat(cells)
        enough[first + n_steps] = False
        at = np.flatnonzero(enough)
        pair = np.searchsorted(first, at, "right") - 1
        out[first_step[pair] + at - first[pair]] = True

    def candidates(self, ids: np.ndarray, open_: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(first word, window, passage, latent cosine) of the windows near a passage.

        Words outside the benchmark's vocabulary are orthogonal to all passages, so windows without any other word are left out.
        """
        x, out = self.index, []
        if not open_.any():
            return out
        n, starts = len(ids), np.arange(0, len(ids), STEP)
        known = np.append(0, np.cumsum(np.add.reduceat(ids < len(x.column), starts, dtype=np.int64)))
        for scale in SCALES:
            k = scale // STEP
            at = np.arange(0, max(1, len(starts) - k // 2), k // 2)
            at = at[open_[at] & (known[np.minimum(at + k, len(starts))] > known[at])]
            # Together are open windows that follow each other, so nothing between stretches is looked up; and no more than PIECE of them.
            cuts = np.flatnonzero(np.diff(at) > 2 * k) + 1
            for some in [x for run in np.split(at, cuts) for x in np.split(run, range(PIECE, len(run), PIECE))] if len(at) else ():
                p = self.window_sums(ids, some, k)
                near = (p @ x.unit.T) / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)
                out += [(int(some[i]) * STEP, scale, j, float(near[i, j])) for i, j in np.argwhere(near >= self.least_cosine).tolist()]
            if n <= scale:
                break
        return out

    def window_sums(self, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        """The latent sums of the windows of k steps that begin at the (ascending) steps ``at``; a word is looked up once for all of them."""
        first = int(at[0])
        own = ids[first * STEP : (int(at[-1]) + k) * STEP]
        where = np.flatnonzero(own < len(self.index.column))
        steps, begin = np.unique(where // STEP, return_index=True)
        sums = np.zeros((int(at[-1]) + k - first, self.index.latent.shape[1]), np.float32)
        sums[steps] = np.add.reduceat(self.index.latent[own[where]], begin)
        return sum(sums[at - first + i] for i in range(k))

    def matches(self, text: str) -> dict[int, tuple[int, int, float, float, bool]]:
        """item_id -> (first word, last word + 1, share of the passage, cosine, answer found) of the best confirmed window."""
        ids, _ = numbered([text], self.terms)
        return self._confirmed(text, ids, self.open_steps(ids))

    def matches_of(self, texts: list[str]) -> Iterator[dict[int, tuple[int, int, float, float, bool]]]:
        """The matches of each text; what no window could confirm is ruled out for all of them together."""
        if not texts:
            return
        ids, sizes = numbered(texts, self.terms)
        for each in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), self.open_steps_of(ids, sizes), strict=True):
            yield self._confirmed(*each)

    def _confirmed(self, text: str, ids: np.ndarray, open_: np.ndarray) -> dict[int, tuple[int, int, float, float, bool]]:
        x, out = self.index, {}
        if not x.phrases and not open_.any():
            return out
        words = words_of(text)
        if x.phrases:
            for at, w in enumerate(words):
                for item, phrase in x.phrases.get(w, ()):
                    if words[at : at + len(phrase)] == phrase:
                        out.setdefault(item, (at, at + len(phrase), 1.0, 1.0, True))
        if not words or not len(x.unit):
            return out
        for start, scale, j, cosine in self.candidates(ids, open_):
            n = len(x.passages[j])
            if x.items[j] in out and out[x.items[j]][2] >= 1:
                continue
            reach = self.reach_of(n, scale)
            a, b = max(0, start - reach), start + scale + reach
            share = lcs(self.bits[j], n, words[a:b]) / n
            if share < self.least_share or (x.items[j] in out and out[x.items[j]][2] >= share):
                continue
            answer = lcs(self.answer_bits[j], len(x.answers[j]), words[a:b]) >= 0.6 * len(x.answers[j])
            if share >= self.sure_share or answer:
                out[x.items[j]] = a, min(b, len(words)), share, cosine, answer
        return out


def leaks(docs: DataFrame, benchmark: DataFrame, least_cosine: float = 0.6, least_share: float = 0.6, sure_share: float = 0.75, rank: int = RANK) -> DataFrame:
    """(doc_id, item_id, first_word, end_word, share, cosine, answer_found): one row for each document and item that it leaks."""
    ddl = "doc_id long, item_id long, first_word int, end_word int, share double, cosine double, answer_found boolean"
    names = [f.name for f in common.pa_schema(ddl)]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = docs.sparkSession.createDataFrame([], ddl)
    for index in build_indexes(docs, benchmark, rank):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def make(sent=sent):
            s = Searcher(sent.value, least_cosine, least_share, sure_share)

            def of(batch):
                found = [(d, i, *m) for d, ms in zip(batch.column(0).to_pylist(), s.matches_of(common.texts(batch)), strict=True) for i, m in ms.items()]
                return {name: [r[k] for r in found] for k, name in enumerate(names)}

            return of

        out = out.unionByName(common.arrow_map(rows, ddl, make))
    return out.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("first_word", "end_word", "share", "cosine", "answer_found"), F.struct("share", "cosine")).alias("m")).select("doc_id", "item_id", "m.*")


def clean(docs: DataFrame, benchmark: DataFrame, least_cosine: float = 0.6, least_share: float = 0.6, sure_share: float = 0.75, rank: int = RANK) -> DataFrame:
    """The rows of docs, with all their columns, that leak no item."""
    def leaking(sent):
        def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            s = Searcher(sent.value, least_cosine, least_share, sure_share)
            for some in texts:
                yield pd.Series([bool(m) for m in s.matches_of([t or "" for t in some])], dtype=bool)

        return F.pandas_udf(of, "boolean")

    out = docs
    for index in build_indexes(docs, benchmark, rank):
        out = out.where(~leaking(docs.sparkSession.sparkContext.broadcast(index))(F.col("text").cast("string")))
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(common.BATCH_ROWS))
    return out
