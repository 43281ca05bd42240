"""Quality classifier by Bradley-Terry pairwise ranking.

Every document gets a few dozen numbers that describe its whole text.  Each pair of a good (label 1) and a bad (label 0)
document is a "match" that the good one wins; a logistic loss on the difference of their features gives the weights of a
latent quality, as in the Bradley-Terry model.  The threshold is the quantile of the training documents' latent
quality at the share of bad labels, and a score is the logistic function of the distance from it.

Cases: a null or empty text has all features 0 and is scored like any other.  Null labels and labels without a
document are not learned from; a label given twice counts once (the larger).  Without both labels, every score is 0.5.
A document given twice is scored twice.  Extra columns of ``documents`` are left aside.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FEATURES = ("words", "word_len", "symbols", "upper", "digits", "bangs", "spaces", "lines", "dup_lines", "distinct", "foreign", "pairs", "stops", "entropy", "bars", "commas", "top_word", "long_words", "line_var", "empty")
_BYTES = {name: np.frombuffer(chars, np.uint8) for name, chars in (("symbols", b"#*$%&<>"), ("digits", b"0123456789"), ("bangs", b"!?"), ("spaces", b" \t\n\r"), ("stops", b"."), ("bars", b"|"), ("commas", b",;:"))}


def features(text: str) -> list[float]:
    """Numbers that describe the whole text, each bounded; see FEATURES."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    n, w = float(len(raw)), float(len(words))
    low, up = hist[97:123].sum(), hist[65:91].sum()
    share = {k: hist[v].sum() / n for k, v in _BYTES.items()}
    p = hist[hist > 0] / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    counts = np.bincount(seq)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    pairs = len(np.unique(seq[:-1] * len(ids) + seq[1:])) / (w - 1) if w > 1 else 1.0
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    return [
        np.log1p(w), lens.mean(), share["symbols"], up / max(1.0, low + up), share["digits"], share["bangs"], share["spaces"],
        np.log1p(len(lines) / w), 1 - len(set(lines)) / len(lines), len(ids) / w, hist[128:].sum() / n, pairs, share["stops"],
        float(-(p * np.log(p)).sum()), share["bars"], share["commas"], counts.max() / w, (lens > 20).mean(), sizes.std() / (1 + sizes.mean()), 0.0,
    ]


def featurised(docs: DataFrame) -> DataFrame:
    """(doc_id, f array<float>) for every row of docs."""

    def make():
        def of(batch):
            return {"doc_id": batch.column(0), "f": [features(t) for t in common.texts(batch)]}

        return of

    return common.arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id long, f array<float>", make)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([z, np.minimum(z * z, 16.0)])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.expand(x) @ self.weights - self.threshold, -30, 30)))


def pair_sums(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Number of pairs of a good and a bad row, and the sums of the loss's gradient and Hessian over all of them; good rows a piece at a time."""
    n = len(w)
    out, bad = np.zeros(1 + n + n * n), z[y == 0]
    for good in np.array_split(z[y == 1], max(1, (y == 1).sum() // 2000)):
        p = 1 / (1 + np.exp(np.clip((good @ w)[:, None] - (bad @ w)[None, :], -30, 30)))
        q = p * (1 - p)
        cross = good.T @ q @ bad
        hess = (good * q.sum(1)[:, None]).T @ good + (bad * q.sum(0)[:, None]).T @ bad - cross - cross.T
        out += np.concatenate([[p.size], bad.T @ p.sum(0) - good.T @ p.sum(1), hess.ravel()])
    return out


def ranked(values: DataFrame, k: int, few: int = 10_000) -> float:
    """The k-th least (from 1) of the column ``latent``: histograms narrow the range down until it holds few rows."""
    low, high, n = values.agg(F.min("latent"), F.max("latent"), F.count("latent")).first()
    while n > few and low < high:
        at = F.least(F.lit(1023), F.floor((F.col("latent") - low) / (high - low) * 1024))
        bins = values.where(F.col("latent").between(low, high)).groupBy(at.alias("b")).agg(F.count(F.lit(1)), F.min("latent"), F.max("latent")).collect()
        for _, n, low, high in sorted(map(tuple, bins)):
            if k <= n:
                break
            k -= n
    return low if low == high else sorted(r[0] for r in values.where(F.col("latent").between(low, high)).select("latent").collect())[k - 1]


def fit(docs: DataFrame, labels: DataFrame, l2: float = 1e-3, steps: int = 25) -> Model:
    """Learn from all labelled documents: Newton steps on the mean of log(1 + exp(-(s(good) - s(bad)))) over pairs, plus l2 * |w|^2.

    Rows are dealt by a hash of the id to blocks of about 2,000 (more where one label is rare, so that each block has some of it); all pairs of a
    block count.  A step's sums (some 1,600 numbers) and the counts of histograms are all that reaches the driver.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    rows = common.stored(featurised(docs.select("doc_id", "text")).join(known, "doc_id").groupBy("doc_id", "quality").agg(F.min("f").alias("f")), "features")
    per_label = {r[0]: r[1] for r in rows.groupBy("quality").count().collect()}
    if len(per_label) < 2:
        return Model(np.zeros(1), np.ones(1), np.zeros(0), 0.0)
    each = [F.col("f")[i].cast("double") for i in range(len(FEATURES))]
    found = np.array(rows.select(*map(F.avg, each), *map(F.stddev_pop, each)).first(), float)
    model = Model(found[: len(each)], found[len(each) :] + 1e-6, np.zeros(2 * len(each)), 0.0)
    blocks = max(1, min(sum(per_label.values()) // 2000, min(per_label.values()) // 20))
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))

    def sums(m: Model):
        def of(block):
            block = block.sort_values("doc_id")
            z = m.expand(np.array(block["f"].tolist(), float))
            return block.head(1).assign(v=[pair_sums(z, block["quality"].to_numpy(), m.weights)])[["v"]]

        return of

    for _ in range(steps):
        parts = dealt.groupBy("b").applyInPandas(sums(model), "v array<double>").select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x")).collect()
        total = np.array([x for _, x in sorted(map(tuple, parts))])
        n, w = len(model.weights), model.weights
        if not total[0]:
            break
        grad, hess = total[1 : n + 1] / total[0] + 2 * l2 * w, total[n + 1 :].reshape(n, n) / total[0] + 2 * l2 * np.eye(n)
        step = np.linalg.solve(hess, grad)
        model = Model(model.mean, model.scale, w - step, 0.0)
        if np.abs(step).max() < 1e-6:
            break

    def latent():
        return lambda batch: {"latent": model.expand(np.array(batch.column(0).to_pylist(), float)) @ model.weights}

    values = common.stored(common.arrow_map(rows.select("f"), "latent double", latent), "latent")
    model.threshold = (ranked(values, per_label[0]) + ranked(values, per_label[0] + 1)) / 2
    common.unstore(values)
    common.unstore(rows)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value

        def of(batch):
            x = np.array([features(t) for t in common.texts(batch)], float)
            return {"doc_id": batch.column(0), "score": m.score(x)}

        return of

    return common.arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id long, score double", make)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all their columns and no others, whose score reaches 0.5, i.e. the quantile threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(text):
        return text.map(lambda t: features(t or "")).pipe(lambda f: f if not len(f) else type(f)(sent.value.score(np.array(f.tolist(), float)) >= 0.5))

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(common.BATCH_ROWS))
    return docs.where(good(F.col("text").cast("string")))
