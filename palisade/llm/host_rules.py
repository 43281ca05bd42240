"""Quality rules with verdicts by host.

Each document is tested by base rules; failures are counted by host; a host's failure rate is shrunk by a beta prior
whose two parameters come from the rates of all hosts, however small (moments), and documents of a host whose shrunk rate is above
``host_rate`` fail with it.

Cases: a null or empty text has no words and fails.  A null host is a host of its own.  Equal rows are judged and counted
one by one.  An empty table gives an empty table.  Extra columns are left aside.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
_SPACE = bytes([0x20, *range(0x09, 0x0E)])


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the whole text."""
    raw = text.encode()
    words = raw.split()  # bytes split at exactly 0x20 and 0x09 to 0x0D
    n = len(words)
    chars = len(text) - sum(raw.count(_SPACE[i : i + 1]) for i in range(len(_SPACE)))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line.strip():
            dup += line in seen
            seen.add(line)
    repeat = 0
    if n >= 4:
        ids: dict[bytes, int] = {}
        seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        _, pair = np.unique(seq[:-1] * len(ids) + seq[1:], return_inverse=True)
        _, which, often = np.unique(pair[:-1] * len(ids) + seq[2:], return_inverse=True, return_counts=True)
        again = np.flatnonzero(often[which] > 1)
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, again, 1)
        np.add.at(cover, again + 3, -1)
        repeat = int((np.cumsum(cover)[:n] > 0).sum())
    return n, chars, symbols, dup, repeat


def judge(docs: DataFrame, host: str = "source", host_rate: float = 0.5, least_words: int = 50, most_repeat: int = 50) -> DataFrame:
    """(doc_id, host, the counts, base_failed, host_docs, host_shrunk_rate, kept) for every row of docs."""

    def make():
        def of(batch):
            c = np.array([counts(t) for t in common.texts(batch)], np.int64)
            return {"doc_id": batch.column(0), "host": batch.column(2)} | {k: c[:, i] for i, k in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))}

        return of

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col(host).cast("string").alias("host"))
    counted = common.arrow_map(rows, "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long", make)
    judged = common.stored(counted.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat * F.col("n_words"))), "host-rules")
    # One row a host: Spark adds up within each task before rows move, so a host with a third of all rows is no burden.
    hosts = judged.groupBy(F.coalesce("host", F.lit("\x00")).alias("h")).agg(F.count(F.lit(1)).alias("n_left"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    hosts = common.stored(hosts, "hosts")
    rate = F.col("failed") / F.col("n_left")
    total, mean, var, inv = hosts.agg(F.sum("n_left"), F.avg(rate), F.var_pop(rate), F.avg(1 / F.col("n_left"))).first()
    rows_all = total or 0
    alpha, beta = beta_prior(mean, var, inv)
    hosts = hosts.select("h", "n_left", ((F.col("failed") + alpha) / (F.col("n_left") + alpha + beta)).alias("host_shrunk_rate"))
    out = common.spread_join(judged.withColumn("h", F.coalesce("host", F.lit("\x00"))), hosts, ["h"], "inner", rows_all)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("host_shrunk_rate") <= host_rate)).withColumnRenamed("n_left", "host_docs").drop("h")


def beta_prior(mean: float | None, var: float | None, inverse_n: float | None) -> tuple[float, float]:
    """Moments of the hosts' rates, less the variance that counting alone gives; (1, 1) where there is nothing to learn from.

    A host of n documents has a rate of variance ``between + (mean * (1 - mean) - between) / n``; that holds for any n.  Hosts of one
    document each tell the mean, but not how hosts differ: their prior weighs two documents, as (1, 1) does.
    """
    if mean is None or not 0 < mean < 1:
        return 1.0, 1.0
    within = float(inverse_n)
    if within > 1 - 1e-9:
        return 2 * mean, 2 * (1 - mean)
    between = max((float(var) - mean * (1 - mean) * within) / (1 - within), 1e-4)
    strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1000.0)
    return mean * strength, (1 - mean) * strength
