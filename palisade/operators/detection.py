"""Stateful detection over history: thresholds, sequences, suppression and alert sessions, keyed and in event-time order.

What a window function can say is one; the greedy rest is a fold over each key's sorted events, which stream through Python: a
key with any number of events needs no more memory than the fold's state.  Thresholds deal keys of very many events to all tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def _us(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _sliced(rows: DataFrame, width: int) -> DataFrame:
    """rows (with their time in ``us``) by slices ``__s`` of eight windows; a row whose window's end lies in the next slice is told there, too (``__own`` is false)."""
    length = 8 * max(1, width)
    at = F.floor(F.col("us") / length).cast("long")
    late = F.col("us") >= (at + 1) * length - width
    both = F.array_compact(F.array(F.struct(at.alias("s"), F.lit(True).alias("own")), F.when(late, F.struct((at + 1).alias("s"), F.lit(False).alias("own")))))
    return rows.withColumn("__x", F.explode(both)).withColumns({"__s": F.col("__x.s"), "__own": F.col("__x.own")}).drop("__x")


def rolling_count(df: DataFrame, key: str, ts: str, seconds: float) -> DataFrame:
    """Events of the key within the window up to each event; those at the very same time count, before or after.  Slices of time are counted apart, so no key is one task's."""
    width = int(seconds * 1_000_000)
    w = Window.partitionBy(key, "__s").orderBy("us").rangeBetween(-width, 0)
    return _sliced(df.withColumn("us", _us(ts)), width).withColumn("n", F.count(F.lit(1)).over(w)).where("__own").drop("us", "__s", "__own")


def rolling_distinct(df: DataFrame, key: str, ts: str, value: str, seconds: float) -> DataFrame:
    """Different values of the key within the window up to each event; those at the very same time count, before or after.

    A value is in the window from each of its times until ``seconds`` after the last one: such spells are found by (key, slice of time, value), and an
    event sees those that began but have not ended, as running sums of beginnings and ends.  An event without a time sees none.
    """
    width = int(seconds * 1_000_000)
    rows = _sliced(df.withColumn("us", _us(ts)), width)
    each = Window.partitionBy(key, "__s", value).orderBy("us")
    before, after = F.lag("us").over(each), F.lead("us").over(each)
    opens, closes = before.isNull() | (F.col("us") - before > width), after.isNull() | (after - F.col("us") > width)
    spells = rows.where(F.col(value).isNotNull() & F.col("us").isNotNull()).select(key, "__s", "us", opens.alias("opens"), closes.alias("closes"))
    # At one time beginnings come first, then the events, then ends.
    ends = F.array_compact(F.array(F.when(F.col("opens"), F.struct(F.col("us").alias("at"), F.lit(0).alias("o"), F.lit(1).alias("d"))), F.when(F.col("closes"), F.struct((F.col("us") + width).alias("at"), F.lit(2).alias("o"), F.lit(-1).alias("d")))))
    event = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    marks = spells.select(key, "__s", F.explode(ends).alias("m")).select(key, "__s", "m.*", F.lit(None).cast(rows.select(event).schema[0].dataType).alias("event"))
    seen = rows.where("__own").select(key, "__s", F.col("us").alias("at"), F.lit(1).alias("o"), F.lit(0).alias("d"), event.alias("event"))
    running = Window.partitionBy(key, "__s").orderBy("at", "o").rowsBetween(Window.unboundedPreceding, 0)
    return marks.union(seen).withColumn("n", F.sum("d").over(running).cast("long")).where("o = 1").select("event.*", "n")


def folded(rows: DataFrame, key: str, order: list[str], keep: list[str], made: str, start: Callable[[], Callable[..., tuple | None]], uses: list[str]) -> DataFrame:
    """The columns ``keep`` of rows, and those that the fold made, where it made any.

    ``start()`` begins a key; the function that it returns sees the columns ``uses`` of one row after the other, in order,
    and gives the made columns' values or None.  Rows stream through: of a key, however large, only the fold's state is held.
    """
    types = StructType([rows.schema[c] for c in keep] + StructType.fromDDL(made).fields)
    new = [to_arrow_type(f.dataType) for f in StructType.fromDDL(made)]

    def run(batches):
        at, step = None, None
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            found, values = [], []
            for i, (k, *x) in enumerate(zip(*[col[c].to_pylist() for c in (key, *uses)], strict=True)):
                if step is None or (k != at and (k == k or at == at)):  # noqa: PLR0124 - a NaN is equal to itself here
                    at, step = k, start()
                if (out := step(*x)) is not None:
                    found.append(i)
                    values.append(out)
            if found:
                made_cols = [pa.array(v, t) for v, t in zip(zip(*values, strict=True), new, strict=True)]
                yield pa.RecordBatch.from_arrays([*(col[c].take(pa.array(found)) for c in keep), *made_cols], types.names)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, types)


#: A key with more rows than this, and more than a thousandth of all rows, is dealt to all tasks by slices of time.
HOT_ROWS = 2_000_000


def hot_keys(rows: DataFrame, key: str, least: int) -> list:
    """(key, n, nulls, lo, hi) of the keys with more than ``least`` rows and a thousandth of all: a thousand at most.  rows: (key, us)."""
    each = rows.groupBy(key).agg(F.count("us").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("us").alias("lo"), F.max("us").alias("hi"))
    share = each.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("__all"))))  # one row
    return share.where((F.col("n") > least) & (F.col("n") > F.col("__all") / 1000)).select(key, "n", (F.col("rows") - F.col("n")).alias("nulls"), "lo", "hi").collect()


def threshold_hits(df: DataFrame, key: str, ts: str, order: str, count: int, window: float, suppress: float, distinct: Column | None = None, hot_rows: int | None = None) -> DataFrame:
    """(key, rn, ts, fired): hits of "count events within window" (edge included), where a hit uses its events up; a hit within suppress of the last fired one only touches it.

    With ``distinct``, different values count (as strings, a missing one as a value) instead of events.  rn: the event's number within its key.
    A key's events stream through the fold; a key of more than ``hot_rows`` goes to all tasks by slices of time (see ``sliced``).
    """
    from . import rule_pack, sliced

    width, quiet = int(window * 1_000_000), int(suppress * 1_000_000)
    value = F.lit(None).cast("string") if distinct is None else distinct.cast("string")
    rows = df.select(key, ts, _us(ts).alias("us"), F.col(order).alias("__o"), value.alias("v"))
    hot = hot_keys(rows, key, HOT_ROWS if hot_rows is None else hot_rows)
    fold = (rule_pack.occurrences if distinct is None else rule_pack.values)(count, width, quiet)

    def start():
        step, rn = fold(), 0

        def one(us: int | None, v: str | None) -> tuple | None:
            nonlocal rn
            rn += 1
            hit = None if us is None else step(us, 1, v)
            return None if hit is None else (rn, hit[2])

        return one

    kinds = f"`{key}` {rows.schema[key].dataType.simpleString()}, hid int, n long, nulls long, lo long, hi long"
    if not hot:
        return folded(rows, key, ["us", "__o"], [key, ts], "rn int, fired boolean", start, ["us", "v"]).select(key, "rn", ts, "fired")
    known = F.broadcast(rows.sparkSession.createDataFrame([(r[0], i, *r[1:]) for i, r in enumerate(hot)], kinds).withColumnRenamed(key, "__k"))
    same = rows[key].eqNullSafe(known["__k"])
    cold = folded(rows.join(known, same, "left_anti"), key, ["us", "__o"], [key, ts], "rn int, fired boolean", start, ["us", "v"]).select(key, "rn", ts, "fired")
    own = rows.where("us is not null").join(known, same).select("hid", "us", F.col("__o").alias("o"), "v", "lo", "n", "hi")
    found = sliced.hits(own, count, width, distinct is not None)
    spans = known.select("hid", "lo", "n", "hi")
    flagged = sliced.fired(found.join(spans, "hid"), quiet)
    at = F.timestamp_micros("us").cast(rows.schema[ts].dataType)
    back = flagged.join(known, "hid").select(F.col("__k").alias(key), (F.col("rn") + F.col("nulls")).cast("int").alias("rn"), at.alias(ts), "fired")
    return cold.unionByName(back)


def alert_sessions(hits: DataFrame, key: str, ts: str, suppress: float, worth: Column) -> DataFrame:
    """(key, first_seen, last_seen, count): hits whose gap is at most suppress belong to one alert; count adds up what each is worth.

    Hits of one stretch of time of that length are always together, so they are added up first, within tasks: only a row for each key and
    stretch is sorted, and a key with a third of all hits is no heavy one.
    """
    quiet = max(1, int(suppress * 1_000_000))
    us = _us(ts)
    pieces = hits.where(F.col(ts).isNotNull()).withColumn("worth", worth).groupBy(key, F.floor(us / quiet).alias("__at")).agg(F.min(us).alias("lo"), F.max(us).alias("hi"), F.sum("worth").alias("n"))
    w = Window.partitionBy(key).orderBy("__at")
    gap = F.col("lo") - F.lag("hi").over(w)
    marked = pieces.withColumn("new", (gap.isNull() | (gap > int(suppress * 1_000_000))).cast("int"))
    numbered = marked.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = numbered.groupBy(key, "session").agg(F.timestamp_micros(F.min("lo")).alias("first_seen"), F.timestamp_micros(F.max("hi")).alias("last_seen"), F.sum("n").cast("long").alias("count"))
    return found.drop("session")


def threshold_alerts(df: DataFrame, key: str, ts: str, order: str, count: int, window: float, suppress: float, distinct: Column | None = None) -> DataFrame:
    """Alerts of a threshold rule: a fired hit is worth its events (or distinct values), a touch one."""
    hits = threshold_hits(df, key, ts, order, count, window, suppress, distinct)
    return alert_sessions(hits, key, ts, suppress, F.when(F.col("fired"), F.lit(count)).otherwise(F.lit(1)))


def sequence_alerts(df: DataFrame, key: str, ts: str, order: str, stages: list[tuple[Column, int]], within: float, exact: bool = True) -> DataFrame:
    """(key, ts, started, n): ends of runs through the stages (predicate, events needed), within the time from the run's start; n: the run's events.

    An event of the current stage counts for it.  Another event of the first stage, once the stage has moved on, either changes nothing
    (``exact=False``), or counts on the same counter, and takes the run back to the second stage when the counter reaches the first stage's
    number (``exact=True``, as rules are written for).  A run older than ``within`` is dropped before the event is looked at; a
    finished run is used up.
    """
    bits = F.array(*[F.coalesce(c, F.lit(False)) for c, _ in stages])
    rows = df.select(key, _us(ts).alias("us"), F.col(order).alias("o"), bits.alias("b")).where(F.exists("b", lambda x: x) & F.col("us").isNotNull())
    needs, width = [n for _, n in stages], int(within * 1_000_000)

    def start():
        stage, count, total, began = 0, 0, 0, None

        def step(us: int, b: list[bool]) -> tuple | None:
            nonlocal stage, count, total, began
            if began is not None and us - began > width:
                stage, count, total, began = 0, 0, 0, None
            own = b[stage]
            if not own and not (exact and b[0]):
                return None
            count, total, began = count + 1, total + 1, us if began is None else began
            if count < needs[stage if own else 0]:
                return None
            stage, count = stage + 1 if own else 1, 0
            if stage < len(needs):
                return None
            done = us, began, total
            stage, total, began = 0, 0, None
            return done

        return step

    ends = folded(rows, key, ["us", "o", "b"], [key], "ended long, began long, n long", start, ["us", "b"])
    return ends.select(key, F.timestamp_micros("ended").alias("ts"), F.timestamp_micros("began").alias("started"), "n")


def samples(hits: DataFrame, key: str, ts: str, order: str, fields: list[str], most: int = 5) -> DataFrame:
    """(key, samples): each key's last events by time, then order, as structs of ``fields``; tasks keep that many of a key before rows move."""
    rows = hits.select(key, ts, order, F.struct(*fields).alias("sample"))
    w = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(order))
    last = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most)
    return last.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("__n", "sample")), asc=False), lambda x: x["sample"]).alias("samples"))
