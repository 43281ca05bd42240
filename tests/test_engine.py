"""The search language, rules, stateful detection, parsers, tables and streaming on small inputs, against plain loops."""

import datetime as dt
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from palisade.functions import scalar
from palisade.operators import aggregates, detection, lookups, matching, rules
from palisade.plans import search_language as search
from palisade.sources import parsers, tables
from palisade.streaming import detect


def t(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def events(spark, rows):
    return spark.createDataFrame([(i, t(s), *r) for i, (s, *r) in enumerate(rows)], "event_id long, ts timestamp, k string, a string")


def test_search_language(spark):
    kinds, crews = ["delivered", "lost", "returned", "held"], ["Zoë", "amir", "Bea"]
    rows = [(i, kinds[i % 4], crews[i % 3], ["fragile", "night"] if i % 5 == 0 else ["day"], f"Parcel no-{i % 7} left by {crews[i % 3]}'s van", None if i == 3 else 100 * i) for i in range(24)]
    df = spark.createDataFrame(rows, "id int, state string, crew string, labels array<string>, note string, grams int")
    f = search.Fields({"state": F.col("state"), "crew": F.col("crew"), "grams": F.col("grams")}, lists={"labels": F.col("labels")}, numbers=frozenset({"grams"}), tokens=search.tokens_of(F.col("note")))
    cases = {
        "": lambda r: True, "*": lambda r: True, "state:LOST": lambda r: r[1] == "lost", "labels:Night": lambda r: "night" in r[3], "NOT labels:night": lambda r: "night" not in r[3], "grams:>1500": lambda r: r[5] is not None and r[5] > 1500,
        "NOT grams:700": lambda r: r[5] not in (None, 700), "state:re*": lambda r: r[1] == "returned", "state:?e*": lambda r: r[1][1] == "e", "crew:(amir OR bea)": lambda r: r[2] != "Zoë", "_exists_:grams": lambda r: r[5] is not None, '"parcel van"': lambda r: True, "zoe van": lambda r: r[2] == "Zoë",
        "no-5": lambda r: r[0] % 7 == 5, "no-*": lambda r: True, "am*": lambda r: r[2] == "amir", "!state:lost grams:<=900": lambda r: r[1] != "lost" and r[5] is not None and r[5] <= 900, "state:lost OR state:held crew:bea": lambda r: r[1] == "lost" or (r[1] == "held" and r[2] == "Bea"),
        "NOT (state:lost OR state:held) AND labels:d*": lambda r: r[1] not in ("lost", "held") and "day" in r[3], 'state:"lost"': lambda r: r[1] == "lost", 'state:"l*"': lambda r: False, "grams:(>=200 AND <400)": lambda r: r[5] in (200,), "...": lambda r: False, '"van ..."': lambda r: True,
    }
    for query, keep in cases.items():
        assert {r.id for r in df.where(search.compile_query(query, f)).select("id").collect()} == {r[0] for r in rows if keep(r)}, query
    for bad in ("(state:lost", "state:", "grams:>many", "@timestamp:1", "state:lost OR", ")", "state:lost AND AND crew:bea", 'crew:"amir', "nofield:1"):
        with pytest.raises(search.QueryError):
            search.compile_query(bad, f)


def test_conditions_and_modifiers(spark):
    df = spark.createDataFrame([("PowerShell -enc", 5, "10.1.2.3"), ("cmd", 9, "192.168.0.1"), (None, None, "x")], "c string, n int, ip string")
    count = lambda spec: df.where(matching.selection(spec, F.col)).count()
    assert count({"c|contains": "powershell"}) == 1 and count({"c|contains|cs": "powershell"}) == 0
    assert count({"c|not": "cmd"}) == 2 and count({"n|gt": 4, "c": "*"}) == 2 and count({"ip|cidr": "10.0.0.0/8"}) == 1
    assert count({"c": None}) == 1 and count({"c|exists": False}) == 1 and count([{"n": 5}, {"n": 9}]) == 2
    assert count({"n": 5}) == 1 and count({"n": [5.0, "9"]}) == 2 and count({"n|gte": True}) in (0, 2)
    floats = spark.createDataFrame([(7.0, "7", "07", True), (7.5, "7.0", "8", False)], "d double, s string, z string, b boolean")
    hits = lambda spec: floats.where(matching.selection(spec, F.col)).count()
    assert [hits({"d": 7}), hits({"s": 7}), hits({"z": 7}), hits({"b": True}), hits({"b|gt": 0})] == [1, 1, 0, 1, 0]
    deep = spark.createDataFrame([((("x", 1),),)], "a struct<b:struct<c:string,d:int>>").select("a", F.lit("flat").alias("a.b.e"))
    assert deep.where(matching.selection({"a.b.c": "X", "a.b.e": "flat", "no.such": None, "a.b.d|gte": 1}, matching.nested(deep.columns))).count() == 1
    assert deep.select(F.lit("run CMD.exe").alias("process.command_line")).where(matching.selection("cmd.exe", matching.nested(["process.command_line"]))).count() == 1
    with pytest.raises(matching.RuleError):
        matching.field_test("c|nope", "x", F.col)
    with pytest.raises(matching.RuleError):
        matching.condition("a and (b", {"a": F.lit(True), "b": F.lit(True)})


def hits_by_loop(times, n, window, suppress):
    recent, fired, out = [], None, []
    for x in times:
        recent = [y for y in recent if y >= x - window] + [x]
        if len(recent) >= n:
            fire = fired is None or x - fired >= suppress
            fired = x if fire else fired
            out.append((x, fire))
            recent = []
    return out


def test_threshold_like_a_loop_in_batch_and_stream(spark, tmp_path):
    rng = random.Random(3)
    keys = {f"k{i}": sorted(rng.sample(range(3000), 40)) for i in range(12)}
    df = events(spark, sorted((s, k, "x") for k, v in keys.items() for s in v))
    want = sorted((k, t(s), f) for k, v in keys.items() for s, f in hits_by_loop(v, 3, 200, 600))
    assert sorted((r.k, r.ts, r.fired) for r in detection.threshold_hits(df, "k", "ts", "event_id", 3, 200, 600).collect()) == want
    path = str(tmp_path / "in")
    df.coalesce(1).write.parquet(path)
    q = detect.threshold_hits(spark.readStream.schema(df.schema).parquet(path), "k", "ts", 3, 200, 600).writeStream.format("memory").queryName("hits").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.k, r.ts, r.fired) for r in spark.table("hits").collect()) == want


def distinct_by_loop(rows, n, window, suppress):
    recent, fired, out = [], None, []
    for x, v in rows:
        recent = [y for y in recent if y[0] >= x - window] + [(x, v)]
        if len({y[1] for y in recent}) >= n:
            fire = fired is None or x - fired >= suppress
            fired = x if fire else fired
            out.append((x, fire))
            recent = []
    return out


def test_distinct_threshold_like_a_loop_in_batch_stream_and_rule(spark, tmp_path):
    rng = random.Random(8)
    keys = {f"k{i}": [(s, rng.choice(["x", "y", "z", "", None])) for s in sorted(rng.choices(range(2000), k=60))] for i in range(12)}
    df = events(spark, sorted(((s, k, v) for k, rows in keys.items() for s, v in rows), key=lambda r: r[0]))
    want = sorted((k, t(s), f) for k, rows in keys.items() for s, f in distinct_by_loop(rows, 3, 120, 400))
    assert sorted((r.k, r.ts, r.fired) for r in detection.threshold_hits(df, "k", "ts", "event_id", 3, 120, 400, F.col("a")).collect()) == want
    path = str(tmp_path / "in")
    df.coalesce(1).write.parquet(path)
    stream = detect.threshold_hits(spark.readStream.schema(df.schema).parquet(path), "k", "ts", 3, 120, 400, F.col("a"), "event_id")
    q = stream.writeStream.format("memory").queryName("distinct_hits").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.k, r.ts, r.fired) for r in spark.table("distinct_hits").collect()) == want
    rule = rules.from_dict({"id": "d", "title": "d", "detection": {"sel": {"k": "h"}}, "threshold": {"count": 3, "window": "5m", "group_by": "k", "distinct": "a"}})
    alerts = lambda values: [(r.group_key, r["count"]) for r in rules.alerts(rule, events(spark, [(i, "h", v) for i, v in enumerate(values)]), "ts", "event_id", F.col).collect()]
    assert alerts(["22", "22", "22", "80", "80", "443"]) == [("k=h", 3)] and alerts(["22"] * 100) == []


def sequences_by_loop(rows, needs, within, exact):
    """rows: (time, stage that the event belongs to)."""
    run, out = None, []  # [stage, counter, events, start]
    for x, a in rows:
        if run and x - run[3] > within:
            run = None
        if run is None:
            if a != 0:
                continue
            run = [0, 0, 0, x]
        if a == run[0]:
            run[1], run[2] = run[1] + 1, run[2] + 1
            if run[1] >= needs[run[0]]:
                run[0], run[1] = run[0] + 1, 0
        elif a == 0 and exact:
            run[1], run[2] = run[1] + 1, run[2] + 1
            if run[1] >= needs[0]:
                run[0], run[1] = 1, 0
        if run[0] == len(needs):
            out.append((x, run[3], run[2]))
            run = None
    return out


@pytest.mark.parametrize("exact", [True, False])
def test_sequences_like_a_loop(spark, exact):
    rng = random.Random(11)
    keys = {f"k{i}": sorted((rng.randrange(3000), rng.randrange(4)) for _ in range(250)) for i in range(20)}
    df = events(spark, [(s, k, str(a)) for k, v in keys.items() for s, a in v])
    for needs in ([3, 1], [2, 2, 1], [1, 3]):
        stages = [(F.col("a") == str(i), n) for i, n in enumerate(needs)]
        want = sorted((k, t(x), t(y), n) for k, v in keys.items() for x, y, n in sequences_by_loop([e for e in v if e[1] < len(needs)], needs, 120, exact))
        assert sorted(tuple(r) for r in detection.sequence_alerts(df, "k", "ts", "a", stages, 120, exact).collect()) == want and want


def test_a_large_key_streams_through_the_folds(spark):
    n = 300_000
    rows = spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("ts"), F.when(F.col("id") % 100 == 1, F.col("id").cast("string")).otherwise("hot").alias("k"), (F.xxhash64("id") % 3).alias("a"))
    hot = [r.event_id for r in rows.where("k = 'hot'").orderBy("event_id").select("event_id").collect()]
    hits = detection.threshold_hits(rows, "k", "ts", "event_id", 3, 60, 30)
    assert not any(word in hits._jdf.queryExecution().toString() for word in ("collect_list", "collect_set"))
    assert sorted((r.ts, r.fired) for r in hits.where("k = 'hot'").collect()) == [(t(s), f) for s, f in hits_by_loop(hot, 3, 60, 30)]
    stages = [(F.col("a") == 0, 2), (F.col("a") == 1, 1), (F.col("a") == 2, 1)]
    ends = detection.sequence_alerts(rows, "k", "ts", "event_id", stages, 20)
    assert "collect_list" not in ends._jdf.queryExecution().toString()
    events = [(r.event_id, r.a) for r in rows.where("k = 'hot' and a >= 0").orderBy("event_id").collect()]
    assert sorted((r.ts, r.started) for r in ends.where("k = 'hot'").collect()) == [(t(a), t(b)) for a, b, _ in sequences_by_loop(events, [2, 1, 1], 20, True)]


def test_cidr_like_the_library(spark):
    ips = ["::1", "::", "2001:db8::1", "2001:DB8:0:0:8:800:200C:417A", "2001:db8:ffff:ffff:ffff:ffff:ffff:ffff", "2001:db9::", "fe80::1%eth0", "::ffff:10.1.2.3", "64:ff9b::1.2.3.4", "1::2::3", ":::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8::", "12345::", ":1", "1:", "g::", "10.1.2.3", "::1.2.3.400", "", "x", None]
    df = spark.createDataFrame([(x,) for x in ips], "ip string")

    def inside(ip, net):
        try:
            return ipaddress.ip_address(ip) in ipaddress.ip_network(net, strict=False)
        except ValueError:
            return False

    for net in ("2001:db8::/32", "::/0", "fe80::/10", "::1/128", "::ffff:0:0/96", "::/96", "64:ff9b::102:304/127"):
        assert {r.ip for r in df.where(scalar.in_cidr(F.col("ip"), net)).collect()} == {x for x in ips if inside(x, net)}, net
    assert {r.ip for r in df.where(scalar.in_cidr(F.col("ip"), "10.0.0.0/8")).collect()} == {"10.1.2.3", "::ffff:10.1.2.3"}


def test_rules_of_every_kind(spark):
    rows = [(10 * i, k, a) for k, acts in {"pump": "wwwwd", "valve": "wwd", "fan": "dwww"}.items() for i, a in enumerate(acts)]
    stages = [{"selection": {"a": "w"}, "count": 3}, {"selection": {"a": "d"}}]
    rule = rules.from_dict({"id": "r", "title": "r", "sequence": {"by": ["k"], "within": "2m", "stages": stages}})
    got = rules.alerts(rule, events(spark, rows), "ts", "event_id", F.col).collect()
    assert [(r.group_key, r.first_seen, r["count"]) for r in got] == [("k=pump", t(40), 5)]  # the fourth warning does not undo the run
    rows = [(0, "pump", "hot"), (200, "pump", "hot"), (500, "valve", "hot"), (820, "pump", "hot"), (821, "pump", "cold")]
    spec = {"id": "s", "title": "s", "group_by": "k", "suppress": "5m", "detection": {"sel": {"a": "hot"}, "condition": "sel"}}
    found = lambda **more: sorted((r.group_key, r["count"]) for r in rules.alerts(rules.from_dict(spec | more), events(spark, rows), "ts", "event_id", F.col).collect())
    assert found() == [("k=pump", 1), ("k=pump", 2), ("k=valve", 1)]
    assert found(suppress=None) == [("k=pump", 1), ("k=pump", 2), ("k=valve", 1)]  # quiet for ten minutes unless the rule says otherwise
    assert found(group_by=None) == [("*", 3), ("*", 1)][::-1] and rules.from_dict(spec | {"suppress": None}).suppress == 600
    assert found(threshold={}) == found() and found(threshold={"count": 2, "group_by": "a"}) == [("a=hot", 2)]
    df, col = events(spark, rows), F.col
    off = rules.from_dict(spec | {"id": "off", "enabled": False})
    broken = rules.from_dict(spec | {"id": "bad", "detection": {"sel": {"nowhere": "x"}}})
    out = rules.all_alerts([rules.from_dict(spec), off, broken], df, "ts", "event_id", col)
    assert {r.rule_id for r in out.collect()} == {"s"} and set(out.failed) == {"bad"}
    assert [r.rules for r in rules.matches([rules.from_dict(spec), off], df, col).orderBy("event_id").collect()] == [["s"]] * 4 + [[]]


def test_log_sources_and_checks(spark):
    df = spark.createDataFrame([("windows.security", "windows"), ("windows", "windows"), ("windowsx", "linux"), (None, None)], "`event.dataset` string, `host.os.type` string")
    count = lambda source: df.where(rules.predicate(rules.from_dict({"id": "x", "title": "x", "logsource": source, "detection": {"s": {"event.dataset|exists": True}}}), matching.nested(df.columns))).count()
    assert [count({"dataset": "Windows"}), count({"service": ["windows.security", "linux"]}), count({"product": "windows"}), count({"product": "linux", "dataset": "windows"})] == [2, 1, 2, 0]
    good = {"id": "x", "title": "x", "detection": {"s": {"a": 1}}}
    for bad in ({"threshold": {"count": 0}}, {"threshold": {"window": "soon"}}, {"sequence": {"stages": [{}]}}, {"suppress": "x"}, {"severity": "dire"}, {"mitre": "T1"}, {"detection": {"s": {"a|re": "("}}}, {"detection": {"s": {"a|cidr": "1.2"}}}, {"detection": {"s": {"a|gt": "x"}}}, {"detection": {"s": {"a": 1}, "condition": "s and"}}, {"detection": {"s": {"a": 1}, "condition": "2 of z*"}}, {"title": ""}):
        with pytest.raises(matching.RuleError):
            rules.from_dict(good | bad)


def test_parsers(spark):
    lines = [
        "Jan  5 10:11:12 web1 sshd[99]: Failed password for invalid user bob from 10.0.0.7 port 22 ssh2",
        '10.1.1.1 - alice [05/Jan/2024:10:00:00 +0000] "GET /a?b=1 HTTP/1.1" 404 12 "-" "curl"',
        "type=USER_AUTH msg=audit(1704450000.123:45): pid=7 acct=\"root\" msg='op=login res=failed'",
        '{"@timestamp": "2024-01-05T10:00:00Z", "event.action": "x", "message": "hi"}',
        "<Event><System><Provider Name='P'/><EventID>4625</EventID><TimeCreated SystemTime='2024-01-05T10:00:00Z'/><Computer>pc</Computer></System><EventData><Data Name='TargetUserName'>eve</Data></EventData></Event>",
        "2024/01/05 10:00:00 [error] 12#12: *3 open failed, client: 10.9.9.9, server: x",
        "10,01/05/24,10:00:00,Assign,10.0.0.9,host9,AABB", "something 1.2.3.4 error k=v", "  ",
    ]
    got = parsers.parse(spark.createDataFrame([(x,) for x in lines], "raw string"), "raw", 2024).collect()
    assert [r.parser for r in got] == ["syslog", "web", "auditd", "json", "windows", "web-error", "dhcp", "generic"]
    assert (got[0].action, got[0].user, got[0].source_ip, got[0].ts) == ("ssh-login-failed", "bob", "10.0.0.7", dt.datetime(2024, 1, 5, 10, 11, 12))
    assert (got[1].outcome, got[1].user, got[2].user, got[2].outcome, got[4].action, got[4].user) == ("failure", "alice", "root", "failure", "logon-failed", "eve")
    assert got[5].source_ip == "10.9.9.9" and got[6].source_ip == "10.0.0.9" and got[7].source_ip == "1.2.3.4"


def test_tables_and_lookups(spark, tmp_path):
    (tmp_path / "l.txt").write_text('{"raw": "a", "dataset": "d"}\n\nplain\n')
    assert sorted((r.raw, r.dataset) for r in tables.envelopes(spark, str(tmp_path / "l.txt")).collect()) == [("a", "d"), ("plain", None)]
    (tmp_path / "r.csv").write_text("# c\n1.0.0.0,1.0.0.255,au\n2.0.0.0,bad,xx\n3.0.0.0,3.0.0.9,ZZ\n")
    assert [r.cc for r in tables.ip_ranges(spark, str(tmp_path / "r.csv")).collect()] == ["AU"]
    df = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "event_id long, v string")
    for _ in range(2):
        tables.append_new(df, str(tmp_path / "ev"))
    assert spark.read.parquet(str(tmp_path / "ev")).count() == 2
    hosts = spark.createDataFrame([(1, "a.evil.example.com."), (2, "com"), (3, None)], "id int, h string")
    got = lookups.by_suffix(hosts, spark.createDataFrame([("example.com",), ("evil.example.com",)], "ind string"), "h", "ind", "id").collect()
    assert {r.id: r.ind for r in got} == {1: "evil.example.com", 2: None, 3: None}
    acts = spark.createDataFrame([(1, 1, "assign", "bo"), (1, 2, "escalate", None), (1, 3, "status", "closed"), (1, 4, "escalate", None)], "id int, ts int, action string, value string")
    assert aggregates.current_alerts(acts).first()[1:] == ("closed", "bo", 1)


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(scalar.ipv4(F.lit("::ffff:1.2.3.4"))) == 0x01020304 and one(scalar.ipv4(F.lit("1.2.3.400"))) is None
    assert one(scalar.basename(F.lit("C:\\a\\b.exe"))) == "b.exe" and one(scalar.to_int(F.lit("0x1F"))) == 31 and one(scalar.cleaned(F.lit("-"))) is None
    assert one(scalar.user_parts(F.lit("D\\u"))) == ("u", "D") and scalar.duration("5m") == 300
    assert one(scalar.timestamp(F.lit("Mar  3 01:02:03"), 2023)) == dt.datetime(2023, 3, 3, 1, 2, 3)
