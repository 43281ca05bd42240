"""Alerts: built from hits, kept by an action log, listed and counted.

The log (id, ts, action, by, args map) is only ever appended to; ``current`` folds it to what holds now.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from . import lookups
from .rules import Rule

# An alert's statuses, those that count as open, and who takes over at each level.
STATUSES = ("new", "acknowledged", "investigating", "escalated", "closed", "false_positive")
OPEN = STATUSES[:4]
TIERS = ("Tier 2 analyst", "SOC lead / incident responder", "Incident manager (CSIRT)")
#: Fields of an event that a sample keeps.
SAMPLE = ("ts", "dataset", "action", "outcome", "host", "user", "target_user", "source_ip", "destination_ip", "destination_port", "program", "message", "tags")


def sample(columns: list[str]) -> Column:
    return F.struct(*[c for c in SAMPLE if c in columns])


def severity_name(score: Column) -> Column:
    """The name of the highest severity that a score reaches."""
    out = F.lit("informational")
    for name, least in sorted(scalar.SEVERITIES.items(), key=lambda x: x[1]):
        out = F.when(score >= least, name).otherwise(out)
    return out


def raised(found: DataFrame, rule: Rule, events: DataFrame, key: Column) -> DataFrame:
    """One row an alert of ``found`` (rule_id, group_key, first_seen, last_seen, count): scores, entity, summary, and the last events of its time as samples.

    ``key``: the events' group key (``rules.group_key``).  Score: the rule's, with the greatest boost of an asset among the events, at least that of
    high if a threat list names one; entity: the group's values, else host, user and address of the last event.
    """
    matched = F.coalesce(F.col("extra")["threat.indicator.matched"] == "true", F.lit(False))
    boost = scalar.boosted_severity(F.lit(rule.score), F.col("extra")["palisade.asset.criticality"], matched)
    rows = events.select(key.alias("group_key"), "ts", "event_id", boost.alias("score"), F.struct("host", F.coalesce("user", "target_user").alias("user"), "source_ip", "destination_ip", "program", F.col("extra")["source.geo.country_name"].alias("country")).alias("last"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), sample(events.columns).alias("sample"))
    alert = found.withColumn("id", scalar.event_id(F.col("rule_id"), F.col("group_key"), F.col("first_seen")))
    # An event belongs to its key's last alert that began before it; keys are cut by days, so none is one task's work.
    day = lambda c: F.floor(F.unix_micros(c) / 86_400_000_000)
    cut = lambda d: F.concat_ws(":", "group_key", d.cast("string"))
    spans = alert.withColumn("__d", F.explode(F.sequence(day(F.col("first_seen")), day(F.col("last_seen"))))).withColumn("__k", cut(F.col("__d")))
    own = lookups.as_of(rows.withColumn("__k", cut(day(F.col("ts")))), spans, "ts", "first_seen", "last_seen", "id", "event_id", "__k")
    hit = rows.join(own.where("id is not null"), "event_id")
    newest = Window.partitionBy("id").orderBy(F.desc("ts"), F.desc("event_id"))
    facts = hit.groupBy("id").agg(F.max("score").alias("score"), F.max_by("last", F.struct("ts", "event_id")).alias("last"), F.max_by("event_id", F.struct("ts", "event_id")).alias("trigger_event_id"))
    last = hit.withColumn("__n", F.row_number().over(newest)).where("__n <= 10").groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("ts"), F.col("event_id"), F.col("sample")))), lambda x: x["sample"]).alias("sample_events"), F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "tags"))), lambda x: x["tags"]))).alias("own_tags"))
    values = F.filter(F.split("group_key", r"\|"), lambda x: ~x.endswith("=") & (x != "*"))
    parts = F.array_compact(F.array(*[F.when(F.col(f"last.{c}").isNotNull(), F.concat(F.lit(f"{n}="), F.col(f"last.{c}"))) for c, n in (("host", "host.name"), ("user", "user.name"), ("source_ip", "source.ip"))]))
    entity = F.array_join(F.when(F.size(values) > 0, values).otherwise(parts), ", ")
    entity = F.when(entity == "", F.coalesce("last.host", F.lit("unknown"))).otherwise(entity)
    score = F.coalesce("score", F.lit(rule.score)).cast("int")
    mitre = F.array(*[F.struct(F.lit(m.get("technique")).cast("string").alias("technique"), F.lit(m.get("tactic")).cast("string").alias("tactic")) for m in rule.mitre]) if rule.mitre else F.array().cast("array<struct<technique:string,tactic:string>>")
    tags = F.array(*map(F.lit, rule.tags)).cast("array<string>")
    return alert.join(facts, "id", "left").join(last, "id", "left").withColumn("entity", entity).select(
        "id", F.lit(rule.kind).alias("kind"), "rule_id", F.lit(rule.title).alias("rule_name"), F.lit(rule.description).alias("rule_description"), severity_name(score).alias("severity"), score.alias("severity_score"), F.lit("new").alias("status"), "group_key", "entity",
        F.concat(F.lit(f"{rule.title} - "), "entity", F.when(F.col("count") > 1, F.concat(F.lit(" ("), F.col("count").cast("string"), F.lit(" events)"))).otherwise("")).alias("summary"), "first_seen", "last_seen", "count", F.col("last.host").alias("host"), F.col("last.user").alias("user"),
        F.col("last.source_ip").alias("source_ip"), F.col("last.country").alias("country"), F.col("last.destination_ip").alias("destination_ip"), F.col("last.program").alias("program"), mitre.alias("mitre"), F.array_distinct(F.concat(tags, F.coalesce("own_tags", F.array().cast("array<string>")))).alias("tags"),
        F.lit(rule.playbook).alias("playbook"), F.array(*map(F.lit, rule.falsepositives)).cast("array<string>").alias("falsepositives"), "trigger_event_id", "sample_events",
    )


def refused(action: str, args: dict[str, str]) -> str | None:
    """Why an action is not taken up in the log, or None."""
    if action not in ("status", "assign", "note", "escalate"):
        return f"unknown action {action}"
    if action == "status" and args.get("value") not in STATUSES:
        return f"status must be one of {', '.join(STATUSES)}"
    return None


def current(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """(id, status, assignee, notes, level, escalated_to, severity, severity_score, history) of every alert (id, severity, severity_score) after its actions.

    Actions are taken in the order of ts, then action.  status, assign and note overwrite; escalate goes one level up (three at most), names who
    takes over, and raises the severity one step unless ``keep_severity`` is given; closed and false_positive alerts refuse it, and a status that is none changes nothing.
    The number of actions of one alert is what people do by hand: one array.
    """
    names = [n for n, _ in sorted(scalar.SEVERITIES.items(), key=lambda x: x[1])]
    entry = "struct<ts:timestamp,status:string,by:string,level:int,reason:string>"
    log = actions.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ts", "action", "by", F.map_entries(F.coalesce("args", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))).alias("args")))).alias("x"))
    state = F.struct(F.lit("new").alias("status"), F.lit(None).cast("string").alias("assignee"), F.lit(None).cast("string").alias("notes"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("escalated_to"), F.col("severity"), F.col("severity_score").cast("int").alias("severity_score"), F.array().cast(f"array<{entry}>").alias("history"))

    def step(a: Column, e: Column) -> Column:
        args = F.map_from_entries(e["args"])
        value = args["value"]
        up = (e["action"] == "escalate") & a["status"].isin(*OPEN)
        set_ = (e["action"] == "status") & value.isin(*STATUSES)
        level = F.when(up, F.least(a["level"] + 1, F.lit(len(TIERS)))).otherwise(a["level"])
        at = F.array_position(F.array(*map(F.lit, names)), a["severity"])
        higher = F.element_at(F.array(*map(F.lit, names)), F.least(at + 1, F.lit(len(names))).cast("int"))
        lifted = up & (at > 0) & F.coalesce(args["keep_severity"] != "true", F.lit(True))
        score = F.create_map(*[F.lit(x) for pair in scalar.SEVERITIES.items() for x in pair])[higher]
        status = F.when(set_, value).when(up, F.lit("escalated")).otherwise(a["status"])
        who = F.coalesce(e["by"], a["assignee"], F.lit("analyst"))
        line = F.struct(e["ts"].alias("ts"), status.alias("status"), who.alias("by"), F.when(up, level).alias("level"), args["reason"].alias("reason")).cast(entry)
        return F.struct(
            status.alias("status"), F.when(e["action"] == "assign", value).otherwise(a["assignee"]).alias("assignee"), F.when(e["action"] == "note", value).otherwise(a["notes"]).alias("notes"), level.alias("level"),
            F.when(up, F.coalesce(F.nullif(F.trim(args["to"]), F.lit("")), F.element_at(F.array(*map(F.lit, TIERS)), level))).otherwise(a["escalated_to"]).alias("escalated_to"),
            F.when(lifted, higher).otherwise(a["severity"]).alias("severity"), F.when(lifted, F.greatest(a["severity_score"], score)).otherwise(a["severity_score"]).alias("severity_score"),
            F.when(set_ | up, F.concat(a["history"], F.array(line))).otherwise(a["history"]).alias("history"),
        )

    both = alerts.select("id", "severity", "severity_score").join(log, "id", "left")
    none = F.array().cast("array<struct<ts:timestamp,action:string,by:string,args:array<struct<key:string,value:string>>>>")
    return both.select("id", F.aggregate(F.coalesce("x", none), state, step).alias("s")).select("id", "s.*")


def selected(alerts: DataFrame, status: tuple[str, ...] = (), severity: tuple[str, ...] = (), rule: str | None = None, since=None, until=None, text: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of alerts, the last seen first (then by id): of these statuses and severities, of a rule, last seen in a time, and with a text anywhere in them."""
    out = alerts
    if status:
        out = out.where(F.col("status").isin(*status))
    if severity:
        out = out.where(F.col("severity").isin(*severity))
    if rule:
        out = out.where(F.col("rule_id") == rule)
    if since is not None:
        out = out.where(F.col("last_seen") >= since)
    if until is not None:
        out = out.where(F.col("last_seen") <= until)
    if text:
        out = out.where(F.lower(F.to_json(F.struct(*out.columns))).contains(text.lower()))
    return out.orderBy(F.desc("last_seen"), "id").offset(offset).limit(limit)


def counts(alerts: DataFrame, by: tuple[str, ...] = ("severity", "status"), rules: int | None = None) -> DataFrame:
    """(what, key, n): alerts by each column, all, and the open ones, in one pass; with ``rules`` that many of the most frequent rules, ties by id."""
    rows = alerts.withColumn("__open", F.col("status").isin(*OPEN)) if "status" in alerts.columns else alerts.withColumn("__open", F.lit(True))
    each = F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).cast("string").alias("key")) for c in by], F.struct(F.lit("total").alias("what"), F.lit(None).cast("string").alias("key")), F.when(F.col("__open"), F.struct(F.lit("open").alias("what"), F.lit(None).cast("string").alias("key"))))
    out = rows.select(F.explode(F.array_compact(each)).alias("x")).groupBy("x.what", "x.key").agg(F.count(F.lit(1)).alias("n"))
    if rules is None:
        return out
    top = alerts.groupBy(F.col("rule_id").alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(rules)
    return out.unionByName(top.select(F.lit("rule").alias("what"), "key", "n"))


def distinct_by(alerts: DataFrame, many: Column, id_col: str, open_: Column | None = None) -> DataFrame:
    """(key, n): different alerts for each element of a list, as tactics; of open ones only if a test is given."""
    rows = alerts if open_ is None else alerts.where(open_)
    return rows.select(id_col, F.explode(many).alias("key")).where("key is not null").groupBy("key").agg(F.count_distinct(id_col).alias("n"))


def to_file(alerts: DataFrame, path: str, least: int = 0) -> None:
    """Appends alerts of a score as JSON lines."""
    alerts.where(F.col("severity_score") >= least).write.mode("append").json(path)
