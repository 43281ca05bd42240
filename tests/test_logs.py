"""Parsers, tables, enrichment, alerts and streams on lines and rows of our own."""

import datetime as dt
import gzip
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from palisade.functions import scalar
from palisade.operators import aggregates, alerts, detection, enrich, lookups, normalise, rules
from palisade.sources import parsers, tables
from palisade.streaming import detect

from .test_engine import events, sequences_by_loop, t

LINES = {
    "<165>1 2024-03-01T05:06:07.089Z box9 crond 77 - - (deploy) CMD (/opt/run --all)": dict(parser="syslog", action="cron-command", user="deploy", host="box9", pid=77, ts=dt.datetime(2024, 3, 1, 5, 6, 7, 89000)),
    "Dec 31 23:59:58 box9 su: FAILED SU (to root) mia on pts/3": dict(action="su-failed", user="mia", target_user="root", outcome="failure", ts=dt.datetime(2023, 12, 31, 23, 59, 58)),
    "Jan  1 00:10:00 box9 sudo:  mia : command not allowed ; TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/cat /etc/shadow": dict(action="sudo-command", user="mia", outcome="failure"),
    "Jan  1 00:10:00 box9 sudo:  mia : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/ls": dict(action="sudo-command", user="mia", target_user="root", outcome="success"),
    "Jan  1 00:10:00 box9 usermod[5]: add 'mia' to group 'wheel'": dict(action="group-member-added", target_user="mia", severity="high"),
    "Jan  1 00:10:00 box9 systemd-logind[1]: New session 12 of user mia.": dict(action="session-started", user="mia"),
    "Jan  1 00:10:00 box9 fail2ban.actions[3]: NOTICE [sshd] Restore Ban 203.0.113.9": dict(action="fail2ban-restore-ban", source_ip="203.0.113.9", dataset="linux.fail2ban"),
    "Jan  1 00:10:00 box9 whatever: plain words": dict(action="whatever-message", message="plain words", dataset="syslog"),
    "type=USER_CMD msg=audit(1709269567.089:4): pid=9 uid=1 cwd=2F686F6D65 cmd=6C73202D6C msg='res=success'": dict(parser="auditd", action="sudo-command", program="ls", ts=dt.datetime(2024, 3, 1, 5, 6, 7, 89000)),
    "node=n1 type=ANOM_ABEND msg=audit(1709269567.089:5): sig=11": dict(parser="auditd", action="auditd-anomaly", severity="medium", host="n1"),
    '{"MESSAGE": "Failed password for root from 2001:db8::7 port 9 ssh2", "SYSLOG_IDENTIFIER": "sshd", "_HOSTNAME": "j1", "__REALTIME_TIMESTAMP": "1709269567089000"}': dict(parser="syslog", action="ssh-login-failed", source_ip="2001:db8::7", ts=dt.datetime(2024, 3, 1, 5, 6, 7, 89000)),
    '{"winlog": {"channel": "System", "event_id": 7045, "event_data": {"ServiceName": "svc", "ImagePath": "C:\\\\s.exe"}}}': dict(parser="windows", dataset="windows.system", action="service-installed", severity="medium"),
    "<Event><System><Provider Name='Microsoft-Windows-Sysmon'/><EventID>10</EventID><Channel>Microsoft-Windows-Sysmon/Operational</Channel></System><EventData><Data Name='SourceImage'>C:\\a\\X.exe</Data><Data Name='TargetImage'>C:\\b\\lsass.exe</Data><Data Name='GrantedAccess'>0x1FFF</Data></EventData></Event>": dict(action="process-accessed", program="x.exe"),
    "<Event><System><EventID>4104</EventID><Channel>Windows PowerShell</Channel></System><EventData><Data Name='ScriptBlockText'>a &amp; b</Data></EventData>": dict(dataset="windows.powershell", action="powershell-scriptblock"),
    "<Event><broken": dict(parser="windows"),
    "<14>x": dict(parser="generic"),
}


def test_parsers_line_by_line(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)] + [(99, None), (98, " \t")], "i int, raw string")
    got = {r.i: r for r in parsers.parse(df, "raw", 2024, now=F.lit(dt.datetime(2024, 1, 1, 1))).collect()}
    assert set(got) == set(range(len(LINES)))
    for i, (line, want) in enumerate(LINES.items()):
        assert {k: got[i][k] for k in want} == want, line


def test_network_keys_like_the_library(spark):
    rng = random.Random(4)
    nets = [f"{ipaddress.ip_address(rng.getrandbits(bits))}/{rng.randrange(bits + 1)}" for bits in (32, 128) for _ in range(60)] + ["10.0.0.1", "::1", "x/3", "10.0.0.0/33", "10.0.0.0/x"]
    got = {r.n: r.k for r in spark.createDataFrame([(n,) for n in nets], "n string").select("n", scalar.network_keys(F.col("n")).alias("k")).collect()}
    for n in nets:
        try:
            net = ipaddress.ip_network(n, strict=False)
            assert tuple(got[n]) == (f"{net.version}{int(net[0]):032x}", f"{net.version}{int(net[-1]):032x}", net.prefixlen)
        except ValueError:
            assert got[n] is None
    ips = [str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(ips)), "i int, ip string")
    some = [(n, n) for n in nets[:60]]
    found = {r.i: r.v for r in lookups.by_network(df, spark.createDataFrame(some, "cidr string, v string"), F.col("ip"), "cidr", "v", "i").collect()}
    for i, ip in enumerate(ips):
        best = max((ipaddress.ip_network(n, strict=False).prefixlen for n, _ in some if ipaddress.ip_address(ip) in ipaddress.ip_network(n, strict=False)), default=None)
        assert (found[i] is None) == (best is None) and (best is None or int(found[i].split("/")[1]) == best)


def test_tables_are_read_and_written(spark, tmp_path):
    with gzip.open(tmp_path / "c.csv.gz", "wt") as f:
        f.write("2001:db8::,2001:db8::ff,bb\n9.0.0.0,9.0.0.255,ZZ\n8.0.0.0,8.255.255.255,aa\nbad,1.2.3.4,cc\n")
    ranges = tables.ip_ranges(spark, str(tmp_path / "c.csv.gz"))
    ips = spark.createDataFrame([("8.1.2.3",), ("9.0.0.1",), ("2001:DB8::1",), ("7.0.0.1",), ("x",)], "ip string")
    assert {r.ip: r.cc for r in lookups.country(ips, ranges, F.col("ip"), "ip").collect()} == {"8.1.2.3": "AA", "9.0.0.1": None, "2001:DB8::1": "BB", "7.0.0.1": None, "x": None}
    (tmp_path / "p.csv").write_text("# c\ncidr,name,lat,lon\n10.0.0.0/8,home,1.5,x\nnone,no,,\n")
    assert [tuple(r)[:2] + (r.lat, r.lon) for r in tables.places(spark, str(tmp_path / "p.csv")).collect()] == [("10.0.0.0/8", "home", 1.5, None)]
    (tmp_path / "a.yml").write_text("assets:\n- {hostnames: [Web1.x], ips: [10.0.0.9], role: web, criticality: high}\nzones:\n- {name: dmz, cidrs: [10.0.0.0/24]}\n")
    known = enrich.inventory(spark, str(tmp_path / "a.yml"))
    assert known.hosts.first().key == "web1" and known.zones.first().zone == "dmz"
    store, day = str(tmp_path / "ev"), lambda i: dt.datetime(2024, 1, 1 + i)
    batch = spark.createDataFrame([(1, day(0)), (2, day(1)), (2, day(1))], "event_id long, ts timestamp")
    for more in (batch, batch, spark.createDataFrame([(2, day(1)), (3, day(2))], batch.schema)):
        tables.append_new(more, store, ts="ts")
    assert sorted(r.event_id for r in spark.read.parquet(store).collect()) == [1, 2, 3]
    stats = spark.createDataFrame([("r", 1, 2)], "id string, hits long, alerts long")
    assert sorted(map(tuple, tables.added_up(stats, spark.createDataFrame([("r", 4, 0), ("s", 1, 1)], stats.schema)).collect())) == [("r", 5, 2), ("s", 1, 1)]
    rule = rules.table(spark, [rules.from_dict({"id": "r", "title": "r", "detection": {"s": {"a": 1}}})])
    assert [tuple(r)[-2:] for r in rules.with_stats(rule, stats, stats.select("id", "hits")).collect()] == [(2, 2)]
    fired, never = rules.coverage(spark.createDataFrame([("one", "r"), ("one", "q")], "scenario string, rule_id string"), spark.createDataFrame([("r",), ("z",)], "id string"))
    assert fired.first().rules == ["q", "r"] and [r.id for r in never.collect()] == ["z"]


def test_enrichment_as_one_chain(spark):
    row = [("Jan  1 00:10:00 web1 sshd[1]: Failed password for mia from 203.0.113.7 port 9 ssh2",), ("Jan  1 00:10:00 pc sshd[1]: Accepted password for leo from 10.0.0.9 port 9 ssh2",)]
    parsed = parsers.parse(spark.createDataFrame(row, "raw string").withColumn("event_id", scalar.event_id(F.col("raw"))), "raw", 2024, chain=("syslog",)).drop("raw")
    asset = F.struct(F.lit("web").alias("role"), F.lit("me").alias("owner"), F.lit("critical").alias("criticality"), F.lit("linux").alias("os"))
    lists = enrich.Tables(("10.0.0.0/24",), networks=spark.createDataFrame([("203.0.113.0/24", "bad net")], "cidr string, description string"), hosts=spark.range(1).select(F.lit("web1").alias("key"), asset.alias("asset")))
    got = {r.host: r for r in enrich.enriched(normalise.normalised(parsed), lists).collect()}
    bad, fine = got["web1"], got["pc"]
    assert (bad.severity_score, bad.tags, bad.extra["network.direction"], bad.extra["source.geo.name"], bad.extra["host.role"], bad.extra["threat.indicator.description"]) == (95, ["threat-intel-match"], "inbound", "Unknown", "web", "bad net")
    assert (fine.severity_score, fine.tags, fine.extra["network.direction"], fine.extra["source.geo.name"]) == (10, [], "internal", "Lab-Network")
    flat = normalise.nested(normalise.normalised(parsed), ["event.category", "host.name", "user.name", "source.ip"]).first().doc
    assert (flat.event.category, flat.host.name, flat.source.ip) == (["authentication"], "web1", "203.0.113.7")
    # A plan in which no step is worked out again for the next: the events are read a few times, not hundreds.
    assert enrich.enriched(normalise.normalised(parsed), lists)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") < 40


def test_alert_actions(spark):
    made = spark.createDataFrame([("a", "medium", 50), ("b", "low", 30)], "id string, severity string, severity_score int")
    acts = [("a", 1, "escalate", "x", {"reason": "r"}), ("a", 2, "escalate", None, {"keep_severity": "true", "to": "boss"}), ("a", 3, "status", "x", {"value": "closed"}), ("a", 4, "escalate", "x", {}), ("a", 5, "status", "x", {"value": "no such"}), ("a", 6, "note", "x", {"value": "n"})]
    log = spark.createDataFrame([(i, t(s), a, b, m) for i, s, a, b, m in acts], "id string, ts timestamp, action string, by string, args map<string,string>")
    got = {r.id: r for r in alerts.current(made, log).collect()}
    a = got["a"]
    assert (a.status, a.level, a.escalated_to, a.severity, a.severity_score, a.notes) == ("closed", 2, "boss", "high", 75, "n")
    assert [(h.status, h.by, h.level) for h in a.history] == [("escalated", "x", 1), ("escalated", "analyst", 2), ("closed", "x", None)]
    assert (got["b"].status, got["b"].level, got["b"].history) == ("new", 0, [])
    assert alerts.refused("status", {"value": "odd"}) and alerts.refused("jump", {}) and alerts.refused("assign", {"value": "x"}) is None


def through(spark, tmp_path, df, make, name):
    path = str(tmp_path / name)
    df.coalesce(1).write.parquet(path)
    q = make(spark.readStream.schema(df.schema).parquet(path)).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_streams_like_the_batch(spark, tmp_path):
    rng = random.Random(7)
    keys = {f"k{i}": sorted((rng.randrange(3000), rng.randrange(3)) for _ in range(80)) for i in range(6)}
    df = events(spark, [(s, k, str(a)) for k, v in keys.items() for s, a in v])
    stages = [(F.col("a") == str(i), n) for i, n in enumerate((2, 1, 1))]
    want = sorted((k, t(x), t(y), n) for k, v in keys.items() for x, y, n in sequences_by_loop(v, [2, 1, 1], 200, True))
    assert sorted(map(tuple, through(spark, tmp_path, df, lambda s: detect.sequence_alerts(s, "k", "ts", stages, 200, "a"), "sequences"))) == want
    # A last event far on moves the watermark, so that all before it ends.
    far = df.union(events(spark, [(90_000, "z", "0")]))
    want = sorted(tuple(r) for r in detection.alert_sessions(df, "k", "ts", 60, F.lit(1)).collect())
    assert sorted(tuple(r) for r in through(spark, tmp_path, far, lambda s: detect.alert_sessions(s, "k", "ts", 60, F.lit(1)), "sessions") if r.k != "z") == want
    quiet = through(spark, tmp_path, far, lambda s: detect.silent(s, "k", "ts", 600), "quiet")
    assert sorted(map(tuple, quiet)) == sorted((k, t(v[-1][0])) for k, v in keys.items())


@pytest.mark.parametrize("seconds", [0, 5, 60])
def test_alert_sessions_and_rolling_counts_like_loops(spark, seconds):
    rng = random.Random(seconds)
    keys = {f"k{i}": sorted((rng.randrange(400), rng.choice("xyz")) for _ in range(60)) for i in range(5)}
    df = events(spark, [(s, k, a) for k, v in keys.items() for s, a in v])
    want = []
    for k, v in keys.items():
        for s, _ in v:
            if want and want[-1][0] == k and s - want[-1][2] <= seconds:
                want[-1][2:] = [s, want[-1][3] + 1]
            else:
                want.append([k, s, s, 1])
    assert sorted(map(tuple, detection.alert_sessions(df, "k", "ts", seconds, F.lit(1)).collect())) == sorted((k, t(a), t(b), n) for k, a, b, n in want)
    seen = sorted((k, t(s), len({b for x, b in v if s - seconds <= x <= s})) for k, v in keys.items() for s, _ in v)
    assert sorted((r.k, r.ts, r.n) for r in detection.rolling_distinct(df, "k", "ts", "a", seconds).collect()) == seen


def test_time_steps_and_texts(spark):
    assert [aggregates.step_for(s, 60) for s in (10, 3600, 86_400, 10**7, 10**10)] == [1, 60, 1800, 172_800, 6 * 365 * 86_400]
    now = dt.datetime(2024, 1, 2)
    assert scalar.moment("now-2H", now) == dt.datetime(2024, 1, 1, 22) and scalar.moment("now", now) == now and scalar.duration("250 MS") == 0.25
    for bad in ("1x", "", "m", "1.2.3s"):
        with pytest.raises(ValueError):
            scalar.duration(bad)
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(scalar.arguments(F.lit("ls -l 'a b' \"c d\""))) == (["ls", "-l", "a b", "c d"], 4) and one(scalar.arguments(F.lit('C:\\x.exe "a b"'))) == (["C:\\x.exe", '"a b"'], 2)
    assert one(scalar.unhexed(F.lit("6C73202D6C"))) == "ls -l" and one(scalar.unhexed(F.lit("ffff"))) == "ffff" and one(scalar.unhexed(F.lit("abc"))) == "abc"
    assert one(scalar.hashes(F.lit("MD5=A, SHA1=B,MD5=C"))) == {"md5": "a", "sha1": "b"} and one(scalar.key_values(F.lit("a=1 b='x y' a=2"))) == {"a": "2", "b": "x y"}
    assert one(scalar.timestamp(F.lit("1704450000.25"), 2024)) == dt.datetime(2024, 1, 5, 10, 20, 0, 250000) and one(scalar.timestamp(F.lit("2024-02-03"), 2024)) == dt.datetime(2024, 2, 3)
    assert one(scalar.with_tag(F.array(F.lit("a")), "b", F.lit(True))) == ["a", "b"] and one(scalar.is_private(F.lit("fd00::1"))) and not one(scalar.is_private(F.lit("8.8.8.8")))
