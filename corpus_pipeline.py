"""A training corpus from raw documents in five stages: quality, repeated lines, near-duplicates, benchmark leaks, tokens.

Part of the subpackage ``palisade.llm``; each stage applies one of its operators to all that the stage before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import common, contract, decontamination, lexicon_bpe, line_runs, ngram_join, quality_ranker


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranker rejects go.  Labels are learned as in op3, so the held-out ones stay unseen."""
    labels = common.table(spark, sf_dir, "labels").where(common.crc_mod(F.col("doc_id"), 3) != 1)
    return quality_ranker.accepted(docs, quality_ranker.fit(docs, labels))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go from the texts; n_chars follows."""
    out = line_runs.deduplicated(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word n-grams, similarity 0.8)."""
    return ngram_join.one_of_each(docs, n=5, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token count and digests of its ids and of the decoded text."""
    built = lexicon_bpe.build(docs, contract.tokenizer_path("word_bpe_49k.json"))
    return lexicon_bpe.encode(docs, built, outputs=("n_tokens", "ids_sha256", "decoded_sha256"), keep=("doc_id", "lang", "source"))


STAGES = [("quality", quality), ("repeated_lines", repeated_lines), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("tokens", tokens)]

#: A classifier that is trained on the way and a public tokenizer are beyond SQL; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
