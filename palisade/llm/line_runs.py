"""Line dedup over a suffix array of line ids, by distributed prefix doubling; DataFrame operations only.

The corpus is one sequence of lines for each document (lines without a word are skipped).  A suffix is a line and what
follows it in its document.  Suffixes are ranked by their first line, then by their first 2, 4, 8 ... lines: a suffix's rank at
depth h is the position of the first suffix with the same h lines, and a depth's key is the pair of two ranks of the depth
before, h lines apart (nearer, so that they overlap, for lengths between powers of two).  Suffixes of one rank are an
interval of the suffix array with a common prefix of h lines or more; a suffix alone in its interval repeats nothing from
there on and leaves the doubling.  Doubling ends at the depth where every suffix has ``min_words`` words, as a longer repeated
run is the union of shorter ones.  All lines of a repeated run of at least ``min_words`` words are deleted, but for
the run's first copy in the order of doc_id and line; overlapping runs merge into maximal ones.

Cases: a null text stays null; a text without words stays as it is.  A null doc_id sorts before all others.  Rows equal in doc_id
and text are one document, and each of them gets its result; rows with one doc_id and different texts are ordered by a
hash of the text.  An empty table gives an empty table.  Extra columns pass through ``deduplicated`` and never clash,
as work columns live in tables of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

_WORD = r"[^\x20\x09-\x0D]"
_POS = ("d", "t", "j")  # a position: document id, hash of its text, number of the line among those with words


def _key(id_col: str = "doc_id", text_col: str = "text") -> tuple[Column, Column]:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64(F.col(text_col).cast("string")).alias("t")


def positions(docs: DataFrame, min_words: int) -> DataFrame:
    """(d, t, j, ln, h1, h2, need, own): each line with a word, its number in the text, its 128-bit id, how many lines from it on have
    min_words words (null: too few are left), and those lines' numbers if they are several."""
    # Columns that a lambda reads are used twice below it, or Spark would work them out anew for each element.
    lines = docs.select(*_key(), F.filter(F.transform(F.split(F.col("text").cast("string"), "\n", -1), lambda x, i: F.struct(i.alias("ln"), x.alias("line"))), lambda x: x["line"].rlike(_WORD)).alias("lines"))
    words = F.transform("lines.line", lambda x: F.size(F.split(F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+")))
    # A line takes its followers' numbers and words along, as many as can matter, not its document's arrays.
    ahead = range(1, min_words)
    shifted = lambda c, k: F.slice(c, k + 1, F.size(c)).alias(f"{c}{k}")
    cols = lines.withColumn("w", words).select("d", "t", F.col("lines.line").alias("line"), F.col("lines.ln").alias("ln"), "w")
    at = cols.select("d", "t", F.posexplode(F.arrays_zip("line", "ln", "w", *[shifted(c, k) for k in ahead for c in ("ln", "w")])).alias("j", "x"))
    upto = [F.col("x.w")]
    for k in ahead:
        upto.append(upto[-1] + F.col(f"x.w{k}"))
    need = F.coalesce(*[F.when(c >= min_words, F.lit(k)) for k, c in enumerate(upto, 1)])
    at = at.select("d", "t", "j", F.col("x.ln").alias("ln"), F.col("x.line").alias("line"), need.alias("need"), F.array("x.ln", *[f"x.ln{k}" for k in ahead]).alias("next"))
    own = F.when(F.col("need") > 1, F.slice("next", 1, F.col("need")))
    return at.select("d", "t", "j", "ln", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), F.col("line")).alias("h2"), "need", own.alias("own"))


def _first_of_class(rows: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Rows whose key occurs at two positions or more, with ``first``, the least position of their key."""
    at = F.struct(*_POS)
    classes = rows.groupBy(*keys).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n_left")).where("first != last").drop("last")
    return common.spread_join(rows, classes, keys, "inner", total).drop("n_left")


def repeated_lines(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """(d, t, gone array<int>): for each document with repeated runs that are not first copies, the numbers of their lines."""
    rows = common.stored(positions(docs, min_words), "lines")
    total = rows.count()
    tied = common.stored(_first_of_class(rows, ["h1", "h2"], total).select(*_POS, "ln", "need", "own", F.col("first").alias("rank")), "depth1")
    later = lambda df: df.where(F.struct(*_POS) > F.col("rank")).select("d", "t", F.explode(F.coalesce("own", F.array("ln"))).alias("ln"))
    cover = [later(tied.where("need = 1"))]
    h, made = 1, [rows, tied]
    while h < min_words:
        order = Window.partitionBy("d", "t").orderBy("j")
        once = tied.groupBy(*_POS).agg(*[F.first(c).alias(c) for c in ("ln", "need", "own", "rank")])  # equal rows of docs are one position
        ahead = [F.when(F.lead("j", k).over(order) == F.col("j") + k, F.lead("rank", k).over(order)).alias(f"r{k}") for k in range(1, h + 1)]
        seen = once.select("*", *ahead)
        keys = [F.when(F.col("need") == h + k, F.struct(F.lit(h + k).alias("len"), F.col("rank").alias("a"), F.col(f"r{k}").alias("b"))) for k in range(1, h)]
        keys.append(F.struct(F.lit(2 * h).alias("len"), F.col("rank").alias("a"), F.col(f"r{h}").alias("b")))
        pairs = seen.select(*_POS, "ln", "need", "own", F.explode(F.array(*keys)).alias("x")).where("x.b is not null").select(*_POS, "ln", "need", "own", "x.*")
        ranked = common.stored(_first_of_class(pairs, ["len", "a", "b"], total).select(*_POS, "ln", "need", "own", "len", F.col("first").alias("rank")), f"depth{2 * h}")
        cover.append(later(ranked.where("need = len")))
        tied = ranked.where(F.col("len") == 2 * h).drop("len")
        made.append(ranked)
        h *= 2
    lines = cover[0]
    for more in cover[1:]:
        lines = lines.union(more)
    gone = lines.groupBy("d", "t").agg(F.sort_array(F.collect_set("ln")).alias("gone"))
    out = common.stored(gone, "gone")
    for x in made:
        common.unstore(x)
    return out


def deduplicated(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """docs with later copies deleted from ``text``; all columns and rows stay.  A text of which every line goes becomes empty."""
    return _joined(docs, min_words).select(*[F.col("kept").alias("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def report(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_runs, text): the lines with a word, how many of them went, in how many maximal runs, and the text that is left."""
    both = _joined(docs, min_words)
    worded = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(_WORD), i)), lambda i: i.isNotNull())
    # Lines with a word as even numbers, and right after its own each deleted one as an odd number: a run begins where the one before is not deleted.
    marks = F.sort_array(F.concat(F.transform("worded", lambda i: 2 * i), F.transform("gone", lambda i: 2 * i + 1)))
    marked = both.withColumn("worded", worded).select("doc", "gone", "kept", "worded", marks.alias("marks"))
    starts = F.filter("marks", lambda x, p: (x % 2 == 1) & F.coalesce(F.get("marks", p - 2) % 2 == 0, F.lit(True)))
    none = F.lit(0).cast("long")
    count = lambda c, a: F.when(c.isNull(), none).otherwise(F.size(a).cast("long"))
    return marked.select(F.col("doc.doc_id").alias("doc_id"), count(F.col("worded"), "worded").alias("n_lines"), count(F.col("gone"), "gone").alias("n_removed"), count(F.col("marks"), starts).alias("n_runs"), F.col("kept").alias("text"))


def _joined(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc, gone, lines, kept): each row of docs as a struct, its lines to delete, its lines, and its text without those."""
    gone = repeated_lines(docs, min_words)
    both = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *_key()).join(gone, ["d", "t"], "left")
    cut = both.select("doc", "gone", F.split(F.col("doc.text").cast("string"), "\n", -1).alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = cut.select("doc", "gone", "lines", F.when(F.col("gone").isNotNull(), left).alias("left"))
    text = F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n")
    return kept.select("doc", "gone", "lines", F.when(F.col("left").isNull(), F.col("doc.text").cast("string")).otherwise(text).alias("kept"))
