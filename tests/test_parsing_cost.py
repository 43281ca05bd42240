"""Times are read as if all patterns were tried; the lines of a file with one row group are parsed by all tasks."""

import datetime as dt

from pyspark.sql import functions as F

from palisade.functions import scalar
from palisade.plans import log_queries

TEXTS = (
    "03/Jan/2024:10:11:12 +0000", "03/Jan/2024:10:11:12", "03/jan/2024:10:11:12", "01/03/2024 10:11:12", "01/03/24 10:11:12", "2024/01/03 10:11:12", "03.01.2024 10:11:12", "Jan 3 10:11:12.123456 2024", "Jan 03 10:11:12.5 2024", "JAN 3 10:11:12 2024",
    "3/Jan/2024:10:11:12", "03/January/2024:10:11:12", "03/Jan/2024:10:11:12 UTC", "03/Jan/2024:10:11:12+0000", "Jan 5 10:00:00 PM", "Sept 5 10:00:00 2024", "Jan 5 24:00:00 2024", "+12024/01/03 10:11:12", "12024/01/03 10:11:12", "01/03/+12024 10:11:12", "Jan 3 10:11:12 +12024", "x:y", "a b: 2024",
)


def test_times_as_if_all_patterns_were_tried(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    every = F.coalesce(*[F.try_to_timestamp("t", F.lit(f)) for f in scalar.TIMES])
    rows = df.select("t", scalar.timestamp(F.col("t"), 2024).cast("string").alias("got"), every.cast("string").alias("want")).collect()
    assert [(r.t, r.got) for r in rows] == [(r.t, r.want) for r in rows]
    assert sum(r.want is not None for r in rows) >= 10


def test_times_without_a_year(spark):
    df = spark.createDataFrame([("Jan 5 10:00:00",), ("Feb  29 10:00:00",), ("Jan 5 10:00:00.5",), ("Jan 5 10:00",)], "t string")
    got = [r[0] for r in df.select(scalar.timestamp(F.col("t"), 2024)).collect()]
    assert got == [dt.datetime(2024, 1, 5, 10), dt.datetime(2024, 2, 29, 10), None, None]


def test_lines_of_one_row_group_are_dealt(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 3, i % 24), i, "error", 1.0, "{}") for i in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = log_queries.parse_web_errors(spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(got) >= spark.sparkContext.defaultParallelism and max(r["count"] for r in got) < 200
