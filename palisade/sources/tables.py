"""Reading and writing: raw lines and envelopes, lookup tables, idempotent appends, newest-by-id snapshots, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..functions.scalar import ip_key, network_keys


# What a sender may say of a line, besides ``fields`` of its own.
META = ("host.name", "host.ip", "host.os.type", "host.os.name", "agent.id", "agent.name", "agent.version", "agent.type", "log.file.path", "@timestamp")


def _enveloped(lines: DataFrame, dataset: str | None) -> DataFrame:
    doc = F.when(F.col("value").rlike(r"^\s*\{"), F.from_json("value", "map<string,string>"))
    said = lines.where(F.col("value").rlike(r"\S")).withColumn("__doc", doc).withColumn("__path", F.input_file_name())
    enveloped = F.coalesce(F.map_contains_key("__doc", F.lit("raw")), F.lit(False))
    none = F.from_json(F.lit("{}"), "map<string,string>")
    fields = F.coalesce(F.from_json(F.col("__doc")["fields"], "map<string,string>"), none)
    own = F.map_filter("__doc", lambda k, _: k.isin(*META) & ~F.map_contains_key(fields, k))
    meta = F.when(enveloped, F.map_concat(own, fields)).otherwise(none)
    hint = F.lit(dataset) if dataset else F.col("__doc")["dataset"]
    return said.select(F.when(enveloped, F.col("__doc")["raw"]).otherwise(F.col("value")).alias("raw"), hint.alias("dataset"), F.col("__path").alias("path"), meta.alias("meta"))


def envelopes(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """(raw, dataset, path, meta): a JSON line with ``raw`` is an envelope, any other line is raw itself; blank lines are skipped.

    meta: what the envelope says of the line's host, agent, file and time, and its ``fields``, under their dotted names; ``parsers.parse`` takes it up."""
    return _enveloped(spark.read.text(path), dataset)


def stream(spark: SparkSession, path: str, dataset: str | None = None, files_per_trigger: int = 1000) -> DataFrame:
    """(raw, dataset, path, meta) of lines as files land below a path (a glob, too); the checkpoint remembers what was read, and a batch takes so many files at most."""
    return _enveloped(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path), dataset)


def ip_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(lo, hi, cc) of ``start,end,CC`` lines, plain or gzip, in any order, with addresses of either version as keys of ``ip_key``; bad lines, and
    ranges that nobody has (``ZZ``), are left out."""
    rows = spark.read.csv(path, schema="a string, b string, cc string", comment="#")
    keys = rows.select(ip_key(F.trim("a")).alias("lo"), ip_key(F.trim("b")).alias("hi"), F.upper(F.trim("cc")).alias("cc"))
    return keys.where((F.col("lo") <= F.col("hi")) & (F.substring("lo", 1, 1) == F.substring("hi", 1, 1)) & (F.col("cc") != "ZZ"))


def places(spark: SparkSession, path: str) -> DataFrame:
    """(cidr, name, country_iso_code, country_name, city_name, organization, lat, lon) of a CSV file of networks with a header; ``#`` starts a comment, bad networks are left out."""
    rows = spark.read.csv(path, header=True, comment="#", mode="PERMISSIVE")
    col = lambda c: (F.nullif(F.trim(c), F.lit("")) if c in rows.columns else F.lit(None).cast("string")).alias(c)
    named = rows.select(*[col(c) for c in ("cidr", "name", "country_iso_code", "country_name", "city_name", "organization", "lat", "lon")])
    return named.where(network_keys(F.col("cidr")).isNotNull()).withColumn("lat", F.col("lat").try_cast("double")).withColumn("lon", F.col("lon").try_cast("double"))


def indicators(spark: SparkSession, path: str) -> DataFrame:
    """(indicator, description) of ``indicator[,description]`` lines; ``#`` starts a comment."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    return spark.read.text(path).select(line.alias("v")).where("v != ''").select(F.lower(F.trim(F.substring_index("v", ",", 1))).alias("indicator"), F.when(F.col("v").contains(","), F.trim(F.regexp_replace("v", "^[^,]*,", ""))).alias("description"))


def append_new(batch: DataFrame, path: str, key: str = "event_id", ts: str | None = None) -> None:
    """Appends the rows whose key the table lacks: a replayed batch changes nothing, and of equal keys in the batch one row stays.

    With ``ts`` the table is cut by day, and only the days of the batch are read; so a key belongs to its day.  A batch that was half written
    is completed by its replay.
    """
    spark = batch.sparkSession
    rows = batch.dropDuplicates([key])
    if ts:
        rows = rows.withColumn("day", F.to_date(ts))
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        known = spark.read.parquet(path)
        if ts:
            days = [r[0] for r in rows.select("day").distinct().collect()]  # days of one batch
            known = known.where(F.col("day").isin([d for d in days if d is not None]) | F.col("day").isNull())
        rows = rows.join(known.select(key), key, "left_anti")
    (rows.write.mode("append").partitionBy("day") if ts else rows.write.mode("append")).parquet(path)


def newest(df: DataFrame, key: str, updated: str) -> DataFrame:
    """The row of each key that was updated last; of equal times the greatest row, column by column.  Columns that have no order (maps) are not compared."""
    rest = [c for c in df.columns if c != key]
    plain = [f.name for f in df.schema.fields if f.name in rest and not isinstance(f.dataType, MapType)]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(updated, *plain)).alias("__r"))
    return best.select(*[F.col(key) if c == key else F.col(f"__r.{c}").alias(c) for c in df.columns])


def added_up(stats: DataFrame, more: DataFrame, key: str = "id") -> DataFrame:
    """Counts of a key added to those that there are; new keys come in."""
    sums = [c for c in stats.columns if c != key]
    return stats.unionByName(more.select(*stats.columns)).groupBy(key).agg(*[F.sum(c).cast("long").alias(c) for c in sums])


def to_envelopes(events: DataFrame, path: str) -> None:
    """Writes (raw, dataset), and what ``meta`` says if there is such a column, as JSON lines that ``envelopes`` reads."""
    said = F.create_map(F.lit("raw"), F.col("raw"), F.lit("dataset"), F.col("dataset"))
    if "meta" in events.columns:
        said = F.map_concat(said, F.coalesce(F.map_filter("meta", lambda k, _: k.isin(*META)), F.from_json(F.lit("{}"), "map<string,string>")))
        rest = F.map_filter("meta", lambda k, _: ~k.isin(*META))
        fields = F.when(F.size(rest) > 0, F.concat(F.lit(', "fields": '), F.to_json(rest), F.lit("}"))).otherwise("}")
        line = F.concat(F.regexp_replace(F.to_json(said), r"\}$", ""), fields)
    else:
        line = F.to_json(said)
    events.select(line.alias("value")).write.mode("append").text(path)


def by_id(spark: SparkSession, path: str, value: object, key: str = "event_id", day: str | None = None) -> DataFrame:
    """The rows of one id.  The filter reaches the files' statistics; with the day of a table that is cut by day, only that day is read."""
    rows = spark.read.parquet(path)
    return rows.where(F.col(key) == value) if day is None else rows.where((F.col("day") == F.lit(day).cast("date")) & (F.col(key) == value))


def retained(events: DataFrame, ts: str, since) -> DataFrame:
    return events.where(F.col(ts) >= since)


def retained_alerts(alerts: DataFrame, last_seen: str, status: str, since) -> DataFrame:
    """Only closed alerts ever expire."""
    return alerts.where((F.col(status) != "closed") | (F.col(last_seen) >= since))
