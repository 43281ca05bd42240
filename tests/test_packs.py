"""Rule packs in one pass, keys of very many events by slices of time, fields of parsed events, envelopes, dry runs."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from palisade.operators import detection, matching, normalise, rules, sliced
from palisade.plans import log_queries
from palisade.sources import parsers, tables

BEGIN = 1704067200


def hot(spark, n=600, seed=4, share=3):
    """Events of which one key holds a third or more, one without a key and one without a time; many at the very same time."""
    rng, rows, at = random.Random(seed), [], 0
    for i in range(n):
        at += rng.choice([0, 0, 1, 1, 2, 3, 30, 200])
        rows.append((i, at, "hot" if i % share == 0 else rng.choice(["a", "b", None]), rng.choice(["x", "y", "z", None])))
    rows.append((n, None, "hot", "x"))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "event_id long, s long, k string, v string")
    return df.select("event_id", F.timestamp_seconds(F.col("s") + BEGIN).alias("ts"), "k", "v")


@pytest.mark.parametrize("distinct", [False, True])
def test_slices_give_what_the_fold_gives(spark, monkeypatch, distinct):
    monkeypatch.setattr(sliced, "ROWS", 40)
    df, value = hot(spark), F.col("v") if distinct else None
    for count, window, suppress in ((3, 10, 30), (2, 3, 500), (3, 60, 0), (1, 5, 20)):
        rows = [sorted(map(tuple, detection.threshold_hits(df, "k", "ts", "event_id", count, window, suppress, value, hot_rows=h).collect()), key=str) for h in (10**9, 50)]
        assert rows[0] == rows[1] and rows[0]


def test_only_keys_above_both_bounds_are_hot(spark):
    df = hot(spark, 900).withColumn("us", F.unix_micros("ts"))
    assert [(r[0], r["n"], r["nulls"]) for r in detection.hot_keys(df.where("k = 'hot' or k = 'a'"), "k", 250)] == [("hot", 300, 1)]


def test_a_slice_of_a_hot_key_is_no_larger_than_others(spark, monkeypatch):
    # A third of all rows have one key: dealt by slices, no task holds much more than the others.
    monkeypatch.setattr(sliced, "ROWS", 500)
    rows = spark.range(30_000).select(F.lit(0).alias("hid"), (F.col("id") * 1_000_000).alias("us"), F.col("id").alias("o"), F.lit(None).cast("string").alias("v"), F.lit(0).cast("long").alias("lo"), F.lit(30_000).cast("long").alias("n"), F.lit(29_999_000_000).alias("hi"))
    found = sliced.hits(rows, 3, 5_000_000, False)
    assert found.count() == 10_000
    assert [r.rn for r in found.orderBy("rn").limit(3).collect()] == [3, 6, 9]


def test_rolling_windows_of_a_hot_key(spark):
    df = hot(spark)
    rows = df.where("ts is not null").collect()
    near = {r.event_id: [x for x in rows if x.k == r.k and 0 <= (r.ts - x.ts).total_seconds() <= 25] for r in rows}
    for got in (detection.rolling_count(df, "k", "ts", 25), detection.rolling_distinct(df, "k", "ts", "v", 25)):
        assert not [w for w in got._jdf.queryExecution().executedPlan().toString().split("\n") if "windowspec" in w and "__s" not in w]
    count = {r.event_id: r.n for r in detection.rolling_count(df, "k", "ts", 25).where("ts is not null").collect()}
    different = {r.event_id: r.n for r in detection.rolling_distinct(df, "k", "ts", "v", 25).where("ts is not null").collect()}
    assert count == {i: len(x) for i, x in near.items()}
    assert different == {i: len({e.v for e in x} - {None}) for i, x in near.items()}
    assert detection.rolling_distinct(df, "k", "ts", "v", 25).where("ts is null").first().n == 0


def test_a_pack_gives_what_each_rule_gives_in_one_pass(spark):
    df = hot(spark, 300)
    column = F.col
    specs = [
        {"id": "m", "title": "m", "suppress": "2m", "group_by": "k", "detection": {"a": {"v": ["x", "y"]}}},
        {"id": "all", "title": "m", "suppress": "1m", "detection": {"a": {"v|exists": True}}},
        {"id": "t", "title": "t", "suppress": "90s", "detection": {"a": {"v|exists": True}}, "threshold": {"count": 3, "window": "60s", "group_by": "k"}},
        {"id": "d", "title": "d", "suppress": "90s", "detection": {"a": {"k|exists": True}}, "threshold": {"count": 3, "window": "60s", "group_by": "k", "distinct": "v"}},
        {"id": "s", "title": "s", "suppress": "1s", "sequence": {"by": ["k"], "within": "5m", "stages": [{"selection": {"v": "x"}, "count": 2}, {"selection": {"v": "z"}}]}},
        {"id": "off", "title": "o", "enabled": False, "detection": {"a": {"v": "x"}}},
    ]
    pack = [rules.from_dict(s) for s in specs]
    bad = [rules.from_dict({"id": "lost", "title": "b", "detection": {"a": {"nowhere": "x"}}}), rules.from_dict({"id": "pattern", "title": "b", "detection": {"a": {"v|re": "(?P<n>x)"}}})]
    found = rules.all_alerts([*bad, *pack], df, "ts", "event_id", column)
    assert set(found.failed) == {"lost", "pattern"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Scan ExistingRDD") <= 1
    each = [r for rule in pack if rule.enabled for r in rules.alerts(rule, df, "ts", "event_id", column).collect()]
    key = lambda r: (r.rule_id, r.group_key, r.first_seen, r.last_seen, r["count"])
    assert sorted(map(key, found.collect())) == sorted(map(key, each)) and {r.rule_id for r in each} == {"m", "all", "t", "d", "s"}
    assert rules.all_alerts([], df, "ts", "event_id", column).count() == 0
    assert rules.all_alerts(pack, df.limit(0), "ts", "event_id", column).count() == 0


def test_an_alert_tells_where_its_first_window_began(spark):
    from palisade.operators import rule_pack

    df = spark.createDataFrame([(i, s, "k") for i, s in enumerate((0, 10, 20, 400))], "event_id long, s long, k string").withColumn("ts", F.timestamp_seconds(F.col("s") + BEGIN))
    rule = rules.from_dict({"id": "t", "title": "t", "detection": {"a": {"k": "k"}}, "threshold": {"count": 3, "window": "60s", "group_by": "k"}})
    (got,) = rule_pack.alerts([rule], df, "ts", "event_id", F.col).collect()
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    assert (got.started, got.first_seen, got["count"]) == (at(0), at(20), 3)


def test_many_texts_at_once_are_each_by_itself(spark):
    texts = ["abc", "ABC", "xabcx", "a.c", "b\n", "b", "", None, "end\n", "*", "ab*c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("l", F.array("t", F.lit("q")))
    for mods in ("", "|contains", "|startswith", "|endswith", "|cs", "|contains|cs", "|not", "|endswith|not", "|all"):
        for values in (["abc", "b"], ["a.c", "end"], ["ABC", "*", "zz"], ["q", "abc"]):
            for name in ("t", "l"):
                lists = frozenset({"l"})
                got = [r[0] for r in df.select(matching.field_test(f"{name}{mods}", values, F.col, lists)).collect()]
                one = [[r[0] for r in df.select(matching.field_test(f"{name}{mods.replace('|not', '').replace('|all', '')}", v, F.col, lists)).collect()] for v in values]
                want = [(all if "all" in mods else any)(x) != ("not" in mods) for x in zip(*one, strict=True)]
                assert got == want, (mods, values, name)


def test_dotted_names_do_not_trip_over_flat_columns(spark):
    df = spark.createDataFrame([("u", "h", {"a.b": "1"}, (2,))], "user string, host string, extra map<string,string>, s struct<x:int>")
    field = matching.nested(df.schema)
    assert df.select(field("user.name"), field("host"), field("s.x"), field("s.y"), field("s.x.z"), field("extra.k")).first()[:] == (None, "h", 2, None, None, None)
    look = normalise.resolver(df)
    assert df.select(look("user.name"), look("host.name"), look("a.b"), look("nothing.here")).first()[:] == ("u", "h", "1", None)


def test_envelopes_reach_the_event(spark, tmp_path):
    sent = [
        {"raw": "Jan  5 10:00:00 box app[1]: hello", "dataset": "linux.auth", "host.name": "sender", "agent.id": "a1", "log.file.path": "/var/log/x", "fields": {"site": "b", "agent.version": 2}},
        {"raw": "no time here", "dataset": "own.thing", "@timestamp": "2024-02-03T04:05:06Z", "host.ip": "10.0.0.1"},
    ]
    (tmp_path / "in.json").write_text("\n".join(map(json.dumps, sent)) + "\n\nplain line\n{\"a\": 1}\n")
    lines = tables.envelopes(spark, str(tmp_path / "in.json"))
    assert sorted((r.raw, r.dataset) for r in lines.collect())[-1] == ('{"a": 1}', None)
    got = {r.raw: r for r in parsers.parse(lines.withColumnRenamed("dataset", "told"), "raw", 2024, hint="told", meta="meta").collect()}
    one, two = got[sent[0]["raw"]], got["no time here"]
    assert (one.host, one.extra["agent.id"], one.extra["log.file.path"], one.extra["site"], one.extra["agent.version"], one.dataset, one.extra["event.module"]) == ("sender", "a1", "/var/log/x", "b", "2", "linux.auth", "syslog")
    assert (two.ts, two.dataset, two.extra["host.ip"], two.extra["event.module"]) == (dt.datetime(2024, 2, 3, 4, 5, 6), "own.thing", "10.0.0.1", "generic")
    tables.to_envelopes(lines.where("raw != 'plain line'"), str(tmp_path / "out"))
    back = tables.envelopes(spark, str(tmp_path / "out"))
    key = lambda r: (r.raw, r.dataset, sorted(r.meta.items()))
    assert sorted(map(key, back.collect()), key=str) == sorted(map(key, lines.where("raw != 'plain line'").collect()), key=str)


def test_a_packs_own_names_are_renamed(spark, tmp_path):
    (tmp_path / "r.yml").write_text('id: r\ntitle: vendor.title\ndetection:\n  a: {"vendor.auth.method|contains": vendor.x}\nthreshold: {count: 2, distinct: vendor.k, group_by: [vendor.g, b]}\n')
    (rule,) = rules.load(str(tmp_path), renamed={"vendor.": "palisade."})
    assert rule.detection == {"a": {"palisade.auth.method|contains": "vendor.x"}} and rule.title == "vendor.title"
    assert rule.threshold == {"count": 2, "distinct": "palisade.k", "group_by": ["palisade.g", "b"]}


def test_a_dry_run_suppresses_nothing(spark):
    df = hot(spark, 60)
    rule = rules.from_dict({"id": "r", "title": "r", "enabled": False, "suppress": "1d", "detection": {"a": {"v": "x"}}})
    alerts, events = rules.dry_run(rule, df, "ts", "event_id", F.col)
    times = {r.ts for r in df.where("v = 'x' and ts is not null").collect()}
    assert alerts.count() == len(times) > 1 and events.count() == df.where("v = 'x'").count()


def test_a_row_by_its_id(spark, tmp_path):
    df = hot(spark, 60).where("ts is not null")
    tables.append_new(df, str(tmp_path / "t"), ts="ts")
    assert tables.by_id(spark, str(tmp_path / "t"), 7).first().event_id == 7
    assert tables.by_id(spark, str(tmp_path / "t"), 7, day="2024-01-01").count() == 1 and tables.by_id(spark, str(tmp_path / "t"), 7, day="2023-01-01").count() == 0


def test_the_pack_of_the_query_holds_all_kinds():
    kinds = [r.kind for r in log_queries.pack_of_rules()]
    assert len(kinds) == 97 and set(kinds) == {"threshold", "sequence"}
