"""Detection over a stream: replayed events go first, matches are a filter, thresholds, sequences and alerts keep a small state for each key.

Each key's state ends by a timer once it can tell nothing any more, on event time: a watermark of ``lateness`` must stand before.  Events of a
micro-batch are taken in the order of their time, then ``order``; across micro-batches in the order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deduplicated(events: DataFrame, ts: str, key: str, lateness: str = "10 minutes") -> DataFrame:
    """Each event id once within the watermark; put before detection, it makes replays harmless."""
    return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def matches(events: DataFrame, predicate: Column) -> DataFrame:
    return events.where(F.coalesce(predicate, F.lit(False)))


def _keep(state, value: tuple, until_us: int) -> None:
    """Keeps the state until the watermark has passed the time."""
    state.update(value)
    state.setTimeoutTimestamp(max(until_us // 1000 + 1, state.getCurrentWatermarkMs() + 1))


def _run(rows: DataFrame, key: str, step, made: str, held: str) -> DataFrame:
    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, {made}", held, "append", "EventTimeTimeout")


def _rows(events: DataFrame, key: str, ts: str, order: str | None, lateness: str | None, *more: Column) -> DataFrame:
    if lateness:
        events = events.withWatermark(ts, lateness)
    return events.select(F.col(key), F.col(ts), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), (F.col(order) if order else F.lit(0)).alias("o"), *more).where("us is not null")


def threshold_hits(events: DataFrame, key: str, ts: str, count: int, window: float, suppress: float, distinct: Column | None = None, order: str | None = None, lateness: str | None = "10 minutes") -> DataFrame:
    """(key, ts, fired) as the batch form gives for events in order; the state is the key's events of one window, less than count, and the last fired time.

    With ``distinct``, different values count (as strings, a missing one as a value) instead of events; the state then holds the last time of each value.
    ``lateness``: None where the stream has its watermark already.
    """
    width, quiet, by_value = int(window * 1_000_000), int(suppress * 1_000_000), distinct is not None

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, *values, fired = state.get if state.exists else ([], None)
        recent = list(zip(times, *values, strict=True)) if values else [(x, "") for x in times]
        rows = sorted((r for f in frames for r in zip(f["us"].tolist(), f["o"].tolist(), f["v"].tolist(), strict=True)), key=lambda r: r[:2])
        out, t = [], 0
        for t, _, v in rows:
            recent = [x for x in recent if x[0] >= t - width and (not by_value or x[1] != v)] + [(t, v)]  # of equal values the last tells all
            if len(recent) >= count:
                fire = fired is None or t - fired >= quiet
                fired = t if fire else fired
                out.append((k[0], pd.Timestamp(t, unit="us"), fire))
                recent = []
        _keep(state, ([x[0] for x in recent], *([[x[1] for x in recent]] if by_value else []), fired), t + max(width, quiet))
        yield pd.DataFrame(out, columns=[key, "ts", "fired"])

    value = F.lit("") if distinct is None else F.coalesce(F.concat(F.lit("="), distinct.cast("string")), F.lit(""))
    rows = _rows(events, key, ts, order, lateness, value.alias("v"))
    return _run(rows, key, step, "ts timestamp, fired boolean", f"recent array<bigint>, {'vals array<string>, ' if by_value else ''}fired bigint")


def sequence_alerts(events: DataFrame, key: str, ts: str, stages: list[tuple[Column, int]], within: float, order: str | None = None, exact: bool = True, lateness: str | None = "10 minutes") -> DataFrame:
    """(key, ts, started, n) as ``operators.detection.sequence_alerts`` gives; the state is one run: its stage, counter, events and start."""
    needs, width = [n for _, n in stages], int(within * 1_000_000)
    bits = F.concat(*[F.when(c, F.lit("1")).otherwise("0") for c, _ in stages])

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stage, counter, total, began = state.get if state.exists else (0, 0, 0, None)
        out = []
        for t, _, b in sorted(r for f in frames for r in zip(f["us"].tolist(), f["o"].tolist(), f["b"].tolist(), strict=True)):
            if began is not None and t - began > width:
                stage, counter, total, began = 0, 0, 0, None
            own = b[stage] == "1"
            if not own and not (exact and b[0] == "1"):
                continue
            counter, total, began = counter + 1, total + 1, t if began is None else began
            if counter >= needs[stage if own else 0]:
                stage, counter = stage + 1 if own else 1, 0
            if stage == len(needs):
                out.append((k[0], pd.Timestamp(t, unit="us"), pd.Timestamp(began, unit="us"), total))
                stage, counter, total, began = 0, 0, 0, None
        if began is None:
            if state.exists:
                state.remove()
        else:
            _keep(state, (stage, counter, total, began), began + width)
        yield pd.DataFrame(out, columns=[key, "ts", "started", "n"])

    rows = _rows(events, key, ts, order, lateness, bits.alias("b")).where(F.col("b").contains("1"))
    return _run(rows, key, step, "ts timestamp, started timestamp, n bigint", "stage int, counter bigint, total bigint, began bigint")


def alert_sessions(hits: DataFrame, key: str, ts: str, suppress: float, worth: Column, lateness: str = "10 minutes") -> DataFrame:
    """(key, first_seen, last_seen, count) of alerts, each once its quiet time has passed the watermark: Spark's own session windows.

    A session's window ends ``suppress`` after its last hit, and a hit at that very time still joins it, as in the batch form.
    """
    gap = f"{max(1, int(suppress * 1_000_000))} microseconds"
    session = F.session_window(F.col(ts), gap)
    found = hits.withWatermark(ts, lateness).groupBy(F.col(key), session).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.sum(worth).cast("long").alias("count"))
    return found.drop("session_window")


def silent(events: DataFrame, key: str, ts: str, seconds: float, lateness: str | None = "10 minutes") -> DataFrame:
    """(key, last_seen) of senders from which nothing has come for so long, by the events' time: once for each silence."""
    quiet = int(seconds * 1_000_000)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame([(k[0], pd.Timestamp(last, unit="us"))], columns=[key, "last_seen"])
            return
        last = max([*(state.get if state.exists else ()), *(int(f["us"].max()) for f in frames)])
        _keep(state, (last,), last + quiet)

    return _run(_rows(events, key, ts, None, lateness), key, step, "last_seen timestamp", "last bigint")
