"""Helpers that the operators share: shared scratch tables, Arrow batches, joins that survive hot keys."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch.  A text is about 3 KB on average and up to some 100 KB, so a batch stays in the low MBs.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``); a temporary one only where the setting is unset and all runs on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage is cut there, and a lost executor costs a re-read only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    gc.collect()
    spark._jvm.System.gc()  # shuffle files of finished jobs go from the executors' disks when the driver drops what refers to them
    return out


def unstore(df: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing reads it any more."""
    spark, path = df.sparkSession, df._stored_at
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def arrow_map(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict] | dict]], rows: int = BATCH_ROWS) -> DataFrame:
    """``mapInArrow`` with small batches.  ``make()`` runs once in each task and returns the function of a batch; that gives columns by name."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    types = pa_schema(schema)

    def run(batches):
        fn = make()
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                for cols in [out] if isinstance(out, dict) else out:
                    yield pa.RecordBatch.from_arrays([c if isinstance(c := cols[f.name], pa.Array) else pa.array(c, f.type) for f in types], schema=types)
        released()

    return df.mapInArrow(run, schema)


def released() -> None:
    """Gives memory back at a task's end: a worker lives on, idle, beside whatever runs next."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def pa_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's texts; a null is an empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the id as decimal text, modulo n; null for a null id."""
    return F.crc32(column.cast("string").cast("binary")) % n


def bounded_labels(known: DataFrame, label: str, rows: int) -> DataFrame:
    """Of (doc_id, label) with the labels 0 and 1 at most ``rows`` rows, and at most half of them of one label: whole buckets of a hash of
    doc_id, in order, as long as they fit; all rows of a label where it has so few.  Buckets have about an eighth of their share's rows."""
    share = rows // 2
    per_label = {r[0]: r[1] for r in known.groupBy(label).count().collect()}
    taken = F.lit(False)
    for value, n in sorted(per_label.items()):
        if n <= share:
            taken = taken | (F.col(label) == value)
            continue
        # Only buckets up to a little beyond the wanted rows are counted, some dozen numbers in all.
        buckets = max(1, 8 * n // share)
        at = F.pmod(F.xxhash64("doc_id"), F.lit(buckets))
        counts = dict(known.where((F.col(label) == value) & (at < 32)).groupBy(at.alias("b")).count().collect())
        end, left = 0, share
        while end < min(buckets, 32) and counts.get(end, 0) <= left:
            left -= counts.get(end, 0)
            end += 1
        taken = taken | ((F.col(label) == value) & (at < end))
    return known.where(taken)


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str, left_total: int, hot_share: float = 0.001) -> DataFrame:
    """Join ``left`` (many rows a key, perhaps a third of them under one) with ``right`` (one row a key, with its count in ``n_left``).

    Keys that hold over ``hot_share`` of the left rows number below ``1 / hot_share``: that bounds the side that is
    broadcast, whatever the data.  Those keys' rows stay where they are; all other keys are joined by a shuffle.
    """
    bar = max(100, int(left_total * hot_share))
    hot = right.where(F.col("n_left") > bar)
    cold = right.where(F.col("n_left") <= bar)
    keys = F.broadcast(hot.select(*on))
    joined = left.join(F.broadcast(hot), on, "inner")
    rest = left.join(keys, on, "left_anti").join(cold, on, how)
    return joined.unionByName(rest)
