"""Counts, terms, filled histograms, alert summaries, and the current state of alerts folded from their action log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def terms(df: DataFrame, value: Column, size: int, is_list: bool = False) -> DataFrame:
    """(value, n) of the most frequent values, ties by value."""
    rows = df.select((F.explode(value) if is_list else value).alias("value")).where("value is not null")
    return rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(size)


def histogram(df: DataFrame, ts: Column, since: Column, until: Column, seconds: int) -> DataFrame:
    """(bucket, n) with a row for each bucket from since to until, both included."""
    step = max(1, int(seconds))
    last = F.floor((F.unix_seconds(until) - F.unix_seconds(since)) / step)
    every = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("bucket"))
    counted = df.where(ts.between(since, until)).groupBy(F.floor((F.unix_seconds(ts) - F.unix_seconds(since)) / step).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


# The steps of a time axis, in seconds: 1 2 5 10 15 30 s and min, 1 2 3 6 12 h, 1 2 7 d, 30 d.
STEPS = (1, 2, 5, 10, 15, 30, 60, 120, 300, 600, 900, 1800, 3600, 7200, 10_800, 21_600, 43_200, 86_400, 172_800, 604_800, 2_592_000)


def step_for(seconds: float, points: int = 60) -> int:
    """The least step that cuts a time into at most so many points; beyond the largest, whole years."""
    year = 365 * 86_400
    return next((s for s in STEPS if seconds / s <= points), max(1, -int(-seconds // (points * year))) * year)


def by_outcome(df: DataFrame, bucket: Column, outcome: Column, values: dict[str, str]) -> DataFrame:
    """(bucket, a column for each name of values): how often each outcome occurs, in one pass."""
    return df.groupBy(bucket.alias("bucket")).agg(*[F.count_if(outcome == v).alias(name) for name, v in values.items()])


def dashboard(events: DataFrame, ts: str, panels: dict[str, Column], since: Column, until: Column, seconds: int, size: int = 10) -> DataFrame:
    """(panel, key, n): the ``size`` most frequent values of each panel and the events of each step of time, from one pass over the events.

    Every event is counted for all panels at once; the counts, one row a panel and value, are what is ranked.
    """
    step = F.floor((F.unix_seconds(F.col(ts)) - F.unix_seconds(since)) / seconds).cast("string")
    each = F.array(F.struct(F.lit("time").alias("panel"), step.alias("key")), *[F.struct(F.lit(p).alias("panel"), c.cast("string").alias("key")) for p, c in panels.items()])
    counted = events.where(F.col(ts).between(since, until)).select(F.explode(each).alias("x")).where("x.key is not null").groupBy("x.panel", "x.key").agg(F.count(F.lit(1)).alias("n"))
    # Steps of time are ranked by themselves, so they all stay; of other panels a task keeps the first ones before rows move.
    w = Window.partitionBy("panel", F.when(F.col("panel") == "time", F.col("key"))).orderBy(F.desc("n"), "key")
    out = counted.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= max(size, 1)).drop("__n")
    return out if size > 0 else out.where("panel = 'time'")


def extent(df: DataFrame, value: str) -> DataFrame:
    """(n, lo, hi) of a table."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))


def page(df: DataFrame, order: list[Column | str], limit: int, offset: int = 0, most: int = 5000) -> DataFrame:
    """A page in the order given; the limit is kept between 1 and ``most``."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), most))


def between(df: DataFrame, ts: str, since: object = None, until: object = None) -> DataFrame:
    """Rows of a time, both ends included; a missing end is open."""
    if since is not None:
        df = df.where(F.col(ts) >= F.lit(since))
    return df.where(F.col(ts) <= F.lit(until)) if until is not None else df


def first_by_id(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in the order given, which should leave no ties; rows meet their key's best within tasks before they move."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return best.select(*[F.col(key) if c == key else F.col(f"__r.{c}").alias(c) for c in df.columns])


def rule_hits(matched: DataFrame) -> DataFrame:
    """(rule_id, hits) from events with the ids of the rules that they match (``rules.matches``)."""
    return matched.select(F.explode("rules").alias("rule_id")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"))


def silent(seen: DataFrame, key: str, ts: str, now: Column, seconds: float, reported: DataFrame | None = None) -> DataFrame:
    """(key, last_seen) of senders whose last event is older than that, but for those already reported since then."""
    last = seen.groupBy(key).agg(F.max(ts).alias("last_seen")).where(F.unix_micros(now) - F.unix_micros("last_seen") > int(seconds * 1_000_000))
    if reported is None:
        return last
    known = reported.select(F.col(key).alias("__k"), F.col("reported_at"))
    return last.join(known, (last[key] == known["__k"]) & (known["reported_at"] >= last["last_seen"]), "left_anti")


def current_alerts(actions: DataFrame) -> DataFrame:
    """(id, status, assignee, level) from actions (id, ts, action, value): ``alerts.current`` for alerts that nothing else is known of."""
    from . import alerts

    log = actions.select("id", F.col("ts").cast("timestamp").alias("ts"), "action", F.lit(None).cast("string").alias("by"), F.create_map(F.lit("value"), F.col("value")).alias("args"))
    known = actions.select("id", F.lit("medium").alias("severity"), F.lit(50).alias("severity_score")).distinct()
    return alerts.current(known, log).select("id", "status", "assignee", "level")
