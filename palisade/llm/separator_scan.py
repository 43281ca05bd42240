"""Token counts by a separator scan of flat token files that have no index.

A flat file is nothing but token ids, each document followed by an end-of-document id; it is read in blocks of fixed size that know nothing of
documents.  Within a block, one vectorised comparison finds the separators and the lengths between them.  A document
may begin in one block and end in a later one, even with whole blocks between: blocks pass on (separators so far, tokens
since the last one), which combine associatively, so a prefix scan over the blocks stitches the pieces, first within
runs of blocks, then over the runs' totals, and no task ever holds a file.

Cases: a block whose length is no multiple of the token width, or an id beyond the width, is an error; two separators in a row are an empty document; tokens after a file's last separator are a document with ended = false.  A null text
is tokenized as an empty one.  Rows with equal or null ids count one by one.  No blocks give no rows.  Extra columns are left aside.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Blocks that a first-level scan goes over.
RUN = 1024
#: Blocks of a flat file that a task reads one after the other.
RANGE_BLOCKS = 256


def tokenized(docs: DataFrame, ranks_path: str, pattern: str, eod: int, block_tokens: int = 1 << 18) -> DataFrame:
    """(file, block, data, first, ids): flat token streams, one a partition of docs, as blocks of uint16 (data); and in rows of
    their own, which the scan does not read, the ids of a file's documents in order, from number ``first`` on."""
    with open(ranks_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
        enc = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        file, block, done, rest = TaskContext.get().partitionId(), 0, 0, np.zeros(0, np.uint16)
        end = np.array([eod], np.uint16)

        def row(block, data, first, ids):
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([data], pa.binary()), pa.array([first], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], ["file", "block", "data", "first", "ids"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            yield row(None, None, done, ids)
            done += len(ids)
            pieces = [rest]
            for t in common.texts(batch):
                tokens = enc.encode_to_numpy(t, disallowed_special=())
                if len(tokens) and tokens.max() > 0xFFFF:
                    raise ValueError(f"token {tokens.max()} does not fit into two bytes")
                pieces += [tokens.astype(np.uint16), end]
            rest = np.concatenate(pieces)
            while len(rest) >= block_tokens:
                yield row(block, rest[:block_tokens].tobytes(), None, None)
                block, rest = block + 1, rest[block_tokens:]
        if len(rest):
            yield row(block, rest.tobytes(), None, None)

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(common.BATCH_ROWS))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "file long, block long, data binary, first long, ids array<long>")


def flat_files(spark: SparkSession, path: str, record_bytes: int) -> DataFrame:
    """(file, block, data) of the binary files below a path (a URI that pyarrow's file systems know, or a local one); each block has ``record_bytes``
    (a multiple of the token width), but for a file's last one.

    The driver lists files and their lengths.  Tasks get ranges of RANGE_BLOCKS blocks and read those alone, a block at a time, so no file is
    too large, and no value is larger than a block.
    """
    store, top = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = store.get_file_info(top)
    found = [info] if info.is_file else [x for x in store.get_file_info(fs.FileSelector(top, recursive=True)) if x.is_file]
    files = spark.createDataFrame([(x.path, x.size) for x in found if x.size], "file string, size long")
    blocks = F.floor((F.col("size") + record_bytes - 1) / record_bytes)
    ranges = files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1, F.lit(RANGE_BLOCKS).cast("long"))).alias("first"), blocks.alias("blocks"))

    def run(batches):
        own = fs.FileSystem.from_uri(path)[0] if "://" in path else fs.LocalFileSystem()
        for batch in batches:
            for file, first, n in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                with own.open_input_file(file) as f:
                    for k in range(first, min(n, first + RANGE_BLOCKS)):
                        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([k], pa.int64()), pa.array([f.read_at(record_bytes, k * record_bytes)], pa.binary())], ["file", "block", "data"])

    return ranges.repartition("file", "first").mapInArrow(run, "file string, block long, data binary")


def scan(blocks: DataFrame, eod: int, dtype: str = "uint16") -> DataFrame:
    """(file, number, n_tokens, ended): each document's length without its separator, from blocks (file, block, data)."""
    kind = blocks.schema["file"].dataType.simpleString()

    def make():
        def of(batch):
            out = {"file": batch.column(0), "block": batch.column(1), "n": [], "n_eod": [], "head": [], "inner": [], "tail": []}
            for data in batch.column(2).to_pylist():
                if len(data) % np.dtype(dtype).itemsize:
                    raise ValueError(f"a block of {len(data)} bytes holds no whole number of {dtype} tokens")
                tokens = np.frombuffer(data, dtype)
                at = np.flatnonzero(tokens == eod)
                out["n"].append(len(tokens))
                out["n_eod"].append(len(at))
                out["head"].append(int(at[0]) if len(at) else len(tokens))
                out["inner"].append(np.diff(at) - 1 if len(at) else [])
                out["tail"].append(len(tokens) - 1 - int(at[-1]) if len(at) else len(tokens))
            return out

        return of

    found = common.stored(common.arrow_map(blocks.select("file", "block", "data"), f"file {kind}, block long, n long, n_eod long, head long, inner array<long>, tail long", make), "blocks")
    # carry into a block: tails summed since the last block with a separator, that block included, as a difference of running sums.
    slim = found.select("file", "block", "n_eod", "tail", (F.col("block") / RUN).cast("long").alias("run"))
    inside = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = slim.withColumn("t", F.coalesce(F.sum("tail").over(inside), F.lit(0))).withColumn("e", F.coalesce(F.sum("n_eod").over(inside), F.lit(0)))
    sums = sums.withColumn("cut", F.max(F.when(F.col("n_eod") > 0, F.col("t"))).over(inside))
    runs = sums.groupBy("file", "run").agg(F.sum("tail").alias("rt"), F.sum("n_eod").alias("re"), F.max(F.when(F.col("n_eod") > 0, F.col("t"))).alias("rcut"))
    over = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("t0", F.coalesce(F.sum("rt").over(over), F.lit(0))).withColumn("e0", F.coalesce(F.sum("re").over(over), F.lit(0)))
    runs = runs.withColumn("cut0", F.max(F.col("t0") + F.col("rcut")).over(over)).select("file", "run", "t0", "e0", "cut0")
    at = sums.join(runs, ["file", "run"]).select("file", "block", (F.col("e") + F.col("e0")).alias("number"), (F.col("t") + F.col("t0") - F.coalesce(F.col("cut") + F.col("t0"), "cut0", F.lit(0))).alias("carry"))
    joined = found.join(at, ["file", "block"])
    ends = joined.where("n_eod > 0").select("file", F.posexplode(F.concat(F.array(F.col("carry") + F.col("head")), "inner")).alias("k", "n_tokens"), "number").select("file", (F.col("number") + F.col("k")).alias("number"), "n_tokens", F.lit(True).alias("ended"))
    last = joined.groupBy("file").agg(F.max_by(F.struct(F.when(F.col("n_eod") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail")).alias("left"), (F.col("number") + F.col("n_eod")).alias("number")), "block").alias("x"))
    return ends.union(last.where("x.left > 0").select("file", "x.number", "x.left", F.lit(False)))


def document_tokens(docs: DataFrame, ranks_path: str, pattern: str, eod: int, block_tokens: int = 1 << 18) -> DataFrame:
    """(doc_id, n_tokens) for every row of docs: tokenized into flat files, counted by scanning those."""
    flat = common.stored(tokenized(docs, ranks_path, pattern, eod, block_tokens), "tokens")
    counts = scan(flat.where("block is not null"), eod)
    order = flat.where("ids is not null").select("file", "first", F.posexplode("ids").alias("k", "doc_id")).select("file", (F.col("first") + F.col("k")).alias("number"), "doc_id")
    return order.join(counts, ["file", "number"]).select("doc_id", "n_tokens")
