"""The registered queries op1_* to op13_*: each applies its operator, with production parameters, to its whole table and derives the agreed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit_packing, collocations, common, decontamination, host_rules, lexicon_bpe, line_runs, ngram_join, pii_weak, quality_ranker, separator_scan, source_divergence, suffix_dedup, toxicity_mil


def tokenizer_path(name: str) -> str:
    """Where the installed public vocabulary files are; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_semantic_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op2_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return separator_scan.document_tokens(common.table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, eod=50256)


def op3_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = quality_ranker.fit(docs, labels.where(common.crc_mod(F.col("doc_id"), 3) != 1))
    return _scored(quality_ranker.score(docs, model), common.crc_mod(F.col("doc_id"), 3) == 1)


def op4_multiple_instance_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = toxicity_mil.fit(docs, labels.where(common.crc_mod(F.col("doc_id"), 5) != 0))
    return _scored(toxicity_mil.score(docs, model), common.crc_mod(F.col("doc_id"), 5) == 0)


def _scored(df: DataFrame, held_out) -> DataFrame:
    return df.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *[F.transform("offending", lambda x: F.concat_ws(":", x["start"], x["end"])).alias("offending") for c in df.columns if c == "offending"])


def op5_ngram_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(common.table(spark, sf_dir, "documents"), n=3, percent=90)


def op6_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.report(common.table(spark, sf_dir, "documents"))


def op7_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    built = lexicon_bpe.build(docs, tokenizer_path("word_bpe_49k.json"))
    return lexicon_bpe.encode(docs, built, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.removed(common.table(spark, sf_dir, "documents"), length=200)
    return out.select("doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(common.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_weak.spans(common.table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(number, pii_weak.BASE), F.sha2(pii_weak.digest(F.col("base")), 256).alias("base_sha256"), pii_weak.digest(F.array_sort(F.concat("base", "added"))).alias("spans"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(common.table(spark, sf_dir, "documents"), least=30, subsumed=80, scale=2_000_000, most=2000)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(common.table(spark, sf_dir, "documents"), least_docs=10, most_terms=10)


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack(common.table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=2048, separator=0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_semantic_leaks, op2_separator_scan, op3_pairwise_quality, op4_multiple_instance_toxicity, op5_ngram_components, op6_line_runs, op7_lexicon_bpe, op8_suffix_dedup, op9_host_rules, op10_weak_pii, op11_collocations, op12_source_divergence, op13_best_fit_packing)
}

_WS = r"[^\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {
    "op5_ngram_components": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WS}') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT b, root FROM reach JOIN both_ways ON a = node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.root AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) r ON r.node = d.doc_id""",
    # A run of lines is repeated as a whole if it is made of windows that end where they first have five words; a window has at most five lines.
    "op6_line_runs": rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents),
p AS (
  SELECT *, len(regexp_extract_all(line, '{_WS}')) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS j FROM l WHERE regexp_matches(line, '{_WS}')),
x AS (
  SELECT *, list(line) OVER f AS ls, list(w) OVER f AS ws FROM p WINDOW f AS (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
s AS (
  SELECT doc_id, j, ls, list_filter(range(1, len(ws) + 1), lambda k: list_sum(ws[1:k]) >= 5)[1] AS need FROM x),
r AS (
  SELECT doc_id, j, need, row_number() OVER (PARTITION BY ls[1:need] ORDER BY doc_id, j) AS copy FROM s WHERE need IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest(range(j, j + need)) AS j FROM r WHERE copy > 1),
n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE before IS NULL OR before < j - 1) AS runs
      FROM (SELECT *, lag(j) OVER (PARTITION BY doc_id ORDER BY j) AS before FROM gone) GROUP BY doc_id),
k AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.ln) AS text FROM l LEFT JOIN p ON p.doc_id = l.doc_id AND p.ln = l.ln
      LEFT JOIN gone ON gone.doc_id = p.doc_id AND gone.j = p.j WHERE gone.j IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_lines, coalesce(m.n, 0)::BIGINT AS n_removed, coalesce(m.runs, 0)::BIGINT AS n_runs,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op9_host_rules": rf"""
WITH t AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WS}') AS ws FROM documents),
win AS (
  SELECT doc_id, i, ws[i:i + 2] AS w, count(*) OVER (PARTITION BY doc_id, ws[i:i + 2]) AS n
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM t)),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '{_WS}') GROUP BY doc_id),
c AS (
  SELECT t.doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM c),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM b GROUP BY source),
mo AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v, avg(1 / n) AS i FROM h),
st AS (SELECT m, CASE WHEN i > 1 - 1e-9 THEN 2 ELSE least(greatest(m * (1 - m) / greatest((v - m * (1 - m) * i) / (1 - i), 1e-4) - 1, 1.0), 1000.0) END AS s FROM mo),
pr AS (SELECT CASE WHEN m > 0 AND m < 1 THEN m * s ELSE 1 END AS al, CASE WHEN m > 0 AND m < 1 THEN (1 - m) * s ELSE 1 END AS be FROM st)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND (f + al) / (n + al + be) <= 0.5) AS kept
FROM b JOIN h ON b.source IS NOT DISTINCT FROM h.source, pr""",
    "op11_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, k AS size, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM places, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND f >= 30),
inside AS (SELECT lang, a AS f, size, unnest(range(2, size)) AS k, ws FROM c WHERE size > 2),
part AS (SELECT lang, f, k, ws, unnest(range(1, size - k + 2)) AS i FROM inside),
longer AS (SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, max(f) AS f FROM part GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN longer l ON l.lang = c.lang AND l.phrase = c.phrase WHERE l.f IS NULL OR 100 * l.f < 80 * a),
cut AS (SELECT *, unnest(range(1, size)) AS k FROM kept),
scored AS (
  SELECT cut.*, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score FROM cut
  JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(ws[1:k], ' ') JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(ws[k + 1:cut.size], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best JOIN n USING (lang) QUALIFY rank <= 2000""",
    "op12_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT id, lang, source, unnest(ws) AS term FROM d),
t AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 10),
gr AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, source, term, count(*) AS n FROM w JOIN t USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM t GROUP BY lang),
gn AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
ln AS (SELECT lang, sum(n) AS n FROM c GROUP BY ALL),
x AS (
  SELECT gr.lang, gr.source, t.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(gn.n, 0) + 2 * v)::HUGEINT)::BIGINT AS p
  FROM gr JOIN t ON t.lang = gr.lang JOIN v ON v.lang = gr.lang LEFT JOIN gn ON gn.lang = gr.lang AND gn.source = gr.source
  LEFT JOIN c ON c.lang = gr.lang AND c.source = gr.source AND c.term = t.term),
lp AS (SELECT lang, term, (1 + 1000000000::HUGEINT * (sum(c.n) + 2) // (max(ln.n) + 2 * max(v))::HUGEINT)::BIGINT AS q FROM c JOIN ln USING (lang) JOIN v USING (lang) GROUP BY ALL),
pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pv.value, 0)::BIGINT AS value FROM gr a JOIN gr b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
tm AS (SELECT x.lang, x.source, 'term' AS part, x.term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM x JOIN lp USING (lang, term) WHERE x.n > 0 AND p > q),
al AS (SELECT * FROM pr UNION ALL SELECT * FROM tm)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM al QUALIFY part = 'pair' OR rank <= 10""",
}
