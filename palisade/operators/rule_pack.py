"""All rules of a pack over history in one pass: one scan of the events, one shuffle, one fold.

An event becomes a row for each rule that it speaks to: the rule's number, its group's key, and the stages or the value that the rule looks at.
Rows of match rules are added up by stretches of time before they move.  Then each (rule, key) is one sorted run of rows that streams through the
rule's own fold: its state is a window's events at most, or a few numbers.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.scalar import duration
from . import matching
from .rules import Rule, group_key, predicate

ALERTS = "rule_id string, group_key string, started timestamp, first_seen timestamp, last_seen timestamp, count long"
#: Rows of match rules that a task adds up at once.
TOGETHER = 500_000

Step = Callable[[int, int, "str | None"], "tuple[int, int, bool] | None"]  # (time, stages, value) -> (worth, when it began, whether it fired)


def occurrences(count: int, width: int, quiet: int) -> Callable[[], Step]:
    """``count`` events within ``width``; a hit uses them up, and within ``quiet`` of the last one that fired it is worth one."""

    def start() -> Step:
        last: deque[int] = deque(maxlen=count)
        fired: int | None = None

        def step(us: int, _: int, __: str | None) -> tuple[int, int, bool] | None:
            nonlocal fired
            last.append(us)
            if len(last) < count or us - last[0] > width:
                return None
            began = last[0]
            last.clear()
            if fired is not None and us - fired < quiet:
                return 1, us, False
            fired = us
            return count, began, True

        return step

    return start


def values(count: int, width: int, quiet: int) -> Callable[[], Step]:
    """As ``occurrences``, for different values."""

    def start() -> Step:
        last: dict[str | None, int] = {}  # each value's last time, the oldest first
        fired: int | None = None

        def step(us: int, _: int, v: str | None) -> tuple[int, int, bool] | None:
            nonlocal fired
            last.pop(v, None)
            last[v] = us
            while us - (old := next(iter(last.items())))[1] > width:
                del last[old[0]]
            if len(last) < count:
                return None
            began = next(iter(last.values()))
            last.clear()
            if fired is not None and us - fired < quiet:
                return 1, us, False
            fired = us
            return count, began, True

        return step

    return start


def stages(needs: list[int], width: int, exact: bool) -> Callable[[], Step]:
    """Runs through stages, as ``detection.sequence_alerts`` has them; a finished run is worth its events."""

    def start() -> Step:
        stage, count, total, began = 0, 0, 0, None

        def step(us: int, bits: int, _: str | None) -> tuple[int, int, bool] | None:
            nonlocal stage, count, total, began
            if began is not None and us - began > width:
                stage, count, total, began = 0, 0, 0, None
            own = bits >> stage & 1
            if not own and not (exact and bits & 1):
                return None
            count, total, began = count + 1, total + 1, us if began is None else began
            if count < needs[stage if own else 0]:
                return None
            stage, count = stage + 1 if own else 1, 0
            if stage < len(needs):
                return None
            done = total, began, True
            stage, total, began = 0, 0, None
            return done

        return step

    return start


def _micros(text: object) -> int:
    return int(duration(text) * 1_000_000)


def fold_of(rule: Rule, exact: bool = True) -> Callable[[], Step] | None:
    """The rule's fold; none where every event is a hit."""
    quiet = int(rule.suppress * 1_000_000)
    if rule.kind == "sequence":
        return stages([int(s.get("count", 1)) for s in rule.sequence["stages"]], _micros(rule.sequence.get("within", "10m")), exact)
    t = rule.threshold or {}
    if int(t.get("count", 1)) == 1:
        return None
    return (values if t.get("distinct") else occurrences)(int(t["count"]), _micros(t.get("window", "5m")), quiet)


def _entry(number: int, rule: Rule, column: Callable[[str], Column], lists: frozenset[str]) -> Column:
    """(rule, key, bits, v) where the event speaks to the rule, else null."""
    if rule.kind == "sequence":
        own = [matching.selection(s["selection"], column, lists) for s in rule.sequence["stages"]]
        bits = reduce(lambda a, b: a + b, [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(own)])
        fits = reduce(lambda a, b: a | b, own)
    else:
        bits, fits = F.lit(1), predicate(rule, column, lists)
    distinct = (rule.threshold or {}).get("distinct") if rule.kind != "sequence" else None
    value = (column(distinct) if distinct else F.lit(None)).cast("string")
    return F.when(fits, F.struct(F.lit(number).alias("rule"), group_key(rule.groups, column, lists).alias("key"), bits.alias("bits"), value.alias("v")))


def compiled(rules: list[Rule], events: DataFrame, column: Callable[[str], Column], lists: frozenset[str]) -> tuple[list[tuple[Rule, Column]], dict[str, str]]:
    """Rules with their entries, and why other rules cannot be: those that do not compile, or that the events cannot answer."""
    column, good, failed = cache(column), [], {}
    for rule in rules:
        try:
            _java_patterns(events, rule)
            good.append((rule, _entry(len(good), rule, column, lists)))
        except Exception as e:  # noqa: BLE001 - one rule must not stop the others
            failed[rule.id] = str(e)

    def bad(part: list[tuple[Rule, Column]]) -> Iterator[tuple[str, str]]:
        """Rules are tried together, then in halves."""
        try:
            events.select(*[c for _, c in part])
        except Exception as e:  # noqa: BLE001
            if len(part) == 1:
                yield part[0][0].id, str(e)
            else:
                for half in (part[: len(part) // 2], part[len(part) // 2 :]):
                    yield from bad(half)

    if odd := dict(bad(good)) if good else {}:
        again, more = compiled([r for r, _ in good if r.id not in odd], events, column, lists)
        return again, failed | odd | more
    return good, failed


def _java_patterns(events: DataFrame, rule: Rule) -> None:
    """Raises where a pattern is one for Python, but not for Spark, which would tell only in the middle of the job."""

    def look(spec: object) -> None:
        for x in spec if isinstance(spec, list) else spec.values() if isinstance(spec, dict) else []:
            look(x)
        for k, v in spec.items() if isinstance(spec, dict) else []:
            if "re" in str(k).split("|")[1:]:
                for p in v if isinstance(v, list) else [v]:
                    events.sparkSession._jvm.java.util.regex.Pattern.compile(str(p))

    look([rule.detection, rule.sequence or {}])


def alerts(rules: list[Rule], events: DataFrame, ts: str, event_id: str, column: Callable[[str], Column], lists: frozenset[str] = frozenset(), exact: bool = True) -> DataFrame:
    """(rule_id, group_key, started, first_seen, last_seen, count) of all enabled rules; ``failed`` of the result says which rules are left out, and why.

    Hits no further apart than the rule's ``suppress`` are one alert, from the first hit to the last.  ``started``: the time of the first event
    that the first hit was made of.
    """
    made, failed = compiled([r for r in rules if r.enabled], events, column, lists)
    if not made:
        out = events.sparkSession.createDataFrame([], ALERTS)
        out.failed = failed
        return out
    ids, folds = [r.id for r, _ in made], [fold_of(r, exact) for r, _ in made]
    quiet = np.array([int(r.suppress * 1_000_000) for r, _ in made], np.int64)
    plain = np.array([f is None for f in folds])
    rows = events.where(F.col(ts).isNotNull()).select(F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(event_id).alias("id"), F.explode(F.array_compact(F.array(*[c for _, c in made]))).alias("e"))
    rows = rows.select("e.rule", "e.key", "us", "id", "e.bits", "e.v")
    id_type = to_arrow_type(rows.schema["id"].dataType)
    types = pa.schema([("rule", pa.int32()), ("key", pa.string()), ("us", pa.int64()), ("id", id_type), ("bits", pa.int32()), ("v", pa.string()), ("hi", pa.int64()), ("n", pa.int64())])

    def together(batches):
        """Rows of match rules become one for each stretch of their quiet time; others pass."""
        held, size = [], 0

        def summed():
            table = pa.concat_tables(held)
            by = table.group_by(["rule", "key", "slot"]).aggregate([("us", "min"), ("us", "max"), ("us", "count")])
            n = by.num_rows
            out = pa.table([by["rule"], by["key"], by["us_min"], pa.nulls(n, id_type), pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.string()), by["us_max"], by["us_count"]], schema=types)
            held.clear()
            return out.to_batches()

        for batch in batches:
            rule, us = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            own = plain[rule]
            if own.any():
                slot = us // np.maximum(1, quiet[rule])
                part = pa.table([batch.column(0), batch.column(1), batch.column(2), pa.array(slot)], ["rule", "key", "us", "slot"]).filter(pa.array(own))
                held.append(part)
                size += part.num_rows
            if not own.all():
                rest = batch.filter(pa.array(~own))
                yield pa.RecordBatch.from_arrays([*rest.columns, rest.column(2), pa.array(np.ones(rest.num_rows, np.int64))], schema=types)
            if size > TOGETHER:
                yield from summed()
                size = 0
        if held:
            yield from summed()

    def fold(batches):
        at, step, alert, quiet_of = None, None, None, 0
        out: list[tuple] = []

        def told():
            cols = list(zip(*out, strict=True))
            out.clear()
            stamp = pa.timestamp("us", tz="UTC")
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), *(pc.cast(pa.array(c, pa.int64()), stamp) for c in cols[2:5]), pa.array(cols[5], pa.int64())], ["rule_id", "group_key", "started", "first_seen", "last_seen", "count"])

        for batch in batches:
            for rule, key, us, _, bits, v, hi, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (rule, key) != at:
                    if alert:
                        out.append((ids[at[0]], at[1], *alert))
                    at, alert, quiet_of = (rule, key), None, int(quiet[rule])
                    step = folds[rule]() if folds[rule] else None
                if step is None:
                    worth, began = n, us
                else:
                    hit = step(us, bits, v)
                    if hit is None:
                        continue
                    worth, began, _ = hit
                if alert and us - alert[2] <= quiet_of:
                    alert[2], alert[3] = max(alert[2], hi), alert[3] + worth
                else:
                    if alert:
                        out.append((ids[at[0]], at[1], *alert))
                    alert = [began, us, hi, worth]
            if len(out) > 10_000:
                yield told()
        if alert:
            out.append((ids[at[0]], at[1], *alert))
        if out:
            yield told()

    id_ddl = rows.schema["id"].dataType.simpleString()
    sent = rows.mapInArrow(together, f"rule int, key string, us long, id {id_ddl}, bits int, v string, hi long, n long")
    out = sent.repartition("rule", "key").sortWithinPartitions("rule", "key", "us", "id").mapInArrow(fold, ALERTS)
    out.failed = failed
    return out
