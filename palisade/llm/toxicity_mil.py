"""Toxicity by multiple-instance learning: a document is toxic if at least one of its sentences is.

A sentence's probability is logistic in the words that it holds and in the words' first four and five letters (inflected
forms share them); the noisy-or ``1 - prod(1 - p)`` of its sentences is
the document's.  Only documents are labelled, so the weights are learned through the noisy-or; afterwards the sentences
whose own probability reaches one half are the offending ones.

Cases: a null or empty text has no sentence and scores 0.  Null labels are not learned from; a label given twice counts
once (the larger).  Without both labels every score is 0.  A document given twice is scored twice.  Extra columns of
``documents`` are left aside.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_WORD = re.compile(r"\w+")


def words(lowered: str) -> set[str]:
    """A sentence's features: distinct words, and the stems ``abcd*`` and ``abcde*`` of longer ones."""
    whole = set(_WORD.findall(lowered))
    long = [w for w in whole if len(w) > 5]
    return whole.union([w[:4] + "*" for w in long], [w[:5] + "*" for w in long])


class Model:
    """weights: word -> logit share; a sentence holds each word once."""

    def __init__(self, bias: float, weights: dict[str, float]):
        self.bias, self.weights = bias, weights

    def spans(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, probability) of every sentence that has a weighted word, in code points."""
        # Most sentences have no word that matters.  Each is lowered by itself, as lower() may change a text's length.
        out, get, known = [], self.weights.get, self.weights.keys()
        for m in _SENTENCE.finditer(text):
            if found := known & words(m[0].lower()):
                out.append((m.start(), m.end(), 1 / (1 + np.exp(-(self.bias + sum(get(w) for w in found))))))
        return out

    def n_sentences(self, text: str) -> int:
        return sum(1 for m in _SENTENCE.finditer(text) if not m[0].isspace())

    def score(self, text: str, spans: list[tuple[int, int, float]]) -> float:
        if not self.weights or not text:
            return 0.0
        plain = max(0, self.n_sentences(text) - len(spans))
        keep = plain * np.log1p(-1 / (1 + np.exp(-self.bias))) + sum(np.log1p(-min(p, 1 - 1e-12)) for _, _, p in spans)
        return float(1 - np.exp(keep))


@dataclass
class Bags:
    """Fitted documents as flat arrays: a document's sentences stand together, a sentence's features too."""

    features: list[str]
    ids: np.ndarray  # int32, features of one sentence after the other
    sentence_ends: np.ndarray  # int64, where each sentence's features end in ids
    document_ends: np.ndarray  # int64, where each document's sentences end in sentence_ends
    y: np.ndarray


class Sums:
    """Sums of x over the members of each group, where members (numbers into x) stand group by group; works on a bounded piece at a time."""

    def __init__(self, members: np.ndarray, ends: np.ndarray, piece: int = 500_000):
        starts = np.append(0, ends[:-1]).astype(np.int64)
        self.n, self.some, self.members = len(ends), np.flatnonzero(ends > starts), members
        starts, ends = starts[self.some], ends[self.some]
        cuts = np.unique(np.searchsorted(ends, np.arange(0, len(members) + piece, piece)))
        self.pieces = [(int(a), int(b), int(starts[a]), int(ends[b - 1]), starts[a:b] - starts[a]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out, found = np.zeros(self.n), np.empty(len(self.some))
        x = x.astype(np.float32)
        for a, b, i, j, starts in self.pieces:
            found[a:b] = np.add.reduceat(x[self.members[i:j]], starts, dtype=np.float64)
        out[self.some] = found
        return out


def bags_of(sentences: list[list[set[str]]], y: np.ndarray, least_docs: int = 8) -> Bags:
    """Bags of documents at hand, as ``fit`` makes them of a table's."""
    df = Counter(w for doc in sentences for w in set().union(*doc))
    features = sorted(w for w, n in df.items() if n >= least_docs)
    at = {w: i for i, w in enumerate(features)}
    rows = [[at[w] for w in s if w in at] for doc in sentences for s in doc]
    return Bags(features, np.array([i for r in rows for i in r], np.int32), np.cumsum([len(r) for r in rows], dtype=np.int64), np.cumsum([len(d) for d in sentences], dtype=np.int64), y)


def fit_noisy_or(bags: Bags, steps: int = 400, l1: float = 2e-4) -> Model:
    """Proximal gradient with Adam's scaling on the documents' log loss; l1 drives the words that tell nothing to 0 exactly.

    Beside the bags it holds them once more by feature, some numbers for each sentence and feature, and one piece's products at a time.
    """
    y, n_feat = bags.y, len(bags.features)
    if not n_feat or len(set(y.tolist())) < 2:
        return Model(-9.0, {})
    n_doc = len(bags.document_ends)
    lens = np.diff(bags.sentence_ends, prepend=0)
    sent_doc = np.repeat(np.arange(n_doc), np.diff(bags.document_ends, prepend=0))
    by_feature = np.argsort(bags.ids, kind="stable").astype(np.int32)
    feature_ends = np.searchsorted(bags.ids[by_feature], np.arange(n_feat), side="right")
    by_feature = np.repeat(np.arange(len(lens), dtype=np.int32), lens)[by_feature]
    of_sentence, of_feature = Sums(bags.ids, bags.sentence_ends), Sums(by_feature, feature_ends)
    # A start that breaks the symmetry: a word's log odds over documents, shrunk.
    seen = np.ones((2, n_feat))
    first = 0
    for d, end in enumerate(bags.document_ends.tolist()):
        lo, hi = (int(bags.sentence_ends[first - 1]) if first else 0), (int(bags.sentence_ends[end - 1]) if end else 0)
        seen[int(y[d]), np.unique(bags.ids[lo:hi])] += 1
        first = end
    odds = np.log(seen[1] / (y.sum() + 2)) - np.log(seen[0] / ((1 - y).sum() + 2))
    w, b = np.where(np.abs(odds) > 0.7, odds, 0.0), -5.0
    m, v = np.zeros(n_feat + 1), np.zeros(n_feat + 1)
    for t in range(1, steps + 1):
        z = b + of_sentence(w)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        q = np.bincount(sent_doc, -np.log1p(-np.minimum(p, 1 - 1e-9)), n_doc)  # -log of the chance that no sentence is toxic
        big = 1 - np.exp(-q)
        slope = np.where(y == 1, -np.exp(-q) / np.maximum(big, 1e-9), 1.0) / n_doc  # of the loss by q
        gz = slope[sent_doc] * p
        g = np.append(of_feature(gz), gz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        rate = 0.1 / (1 + t / 200)
        size = np.sqrt(v / (1 - 0.99**t)) + 1e-6
        step = rate * (m / (1 - 0.9**t)) / size
        w, b = w - step[:-1], b - step[-1]
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * l1 / np.maximum(size[:-1], l1))
        b = min(b, -2.0)
    return Model(float(b), {word: float(x) for word, x in zip(bags.features, w, strict=True) if abs(x) > 0.05})


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 6_000, least_docs: int = 8) -> Model:
    """Learn from at most ``fit_rows`` labelled documents, half of each label where there are so many, picked by a hash of the id.

    Spark counts the documents of each feature; those of ``least_docs`` fitted documents or more get a number, and a picked text
    reaches the driver as its sentences' numbers only (4 bytes each), so the bound on rows bounds that.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    picked = common.bounded_labels(known, "toxic", fit_rows)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    chosen = common.stored(texts, "fitted")

    def distinct():
        return lambda batch: {"w": [w for t in common.texts(batch) for w in set().union(*map(words, _SENTENCE.findall(t.lower())))]}

    features = common.arrow_map(chosen.select("text"), "w string", distinct).groupBy("w").count().where(F.col("count") >= least_docs).select("w").toArrow()
    names = sorted(features.column(0).to_pylist())
    sent = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(names)})

    def numbered():
        at = sent.value

        def of(batch):
            out = {"doc_id": batch.column(0), "toxic": batch.column(1), "lens": [], "ids": []}
            for t in common.texts(batch):
                rows = [sorted(at[w] for w in at.keys() & found) for s in _SENTENCE.findall(t.lower()) if (found := words(s))]
                out["lens"].append([len(r) for r in rows])
                out["ids"].append([i for r in rows for i in r])
            return out

        return of

    table = common.arrow_map(chosen.select("doc_id", "toxic", "text"), "doc_id long, toxic int, lens array<int>, ids array<int>", numbered).toArrow().sort_by("doc_id").combine_chunks()
    common.unstore(chosen)
    if not table.num_rows or not names:
        return Model(-9.0, {})
    lens, ids = (table.column(c).chunk(0) for c in ("lens", "ids"))
    bags = Bags(names, ids.flatten().to_numpy(), np.cumsum(lens.flatten().to_numpy(), dtype=np.int64), np.cumsum(lens.value_lengths().to_numpy(), dtype=np.int64), table.column("toxic").to_numpy())
    return fit_noisy_or(bags)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, offending array<struct<start,end,p>>) for every row of docs: sentences with a probability of one half or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value

        def of(batch):
            scores, found = [], []
            for t in common.texts(batch):
                spans = m.spans(t)
                scores.append(m.score(t, spans))
                found.append([{"start": a, "end": b, "p": float(p)} for a, b, p in spans if p >= 0.5])
            return {"doc_id": batch.column(0), "score": scores, "offending": found}

        return of

    return common.arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id long, score double, offending array<struct<start:int,end:int,p:double>>", make)
