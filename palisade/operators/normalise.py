"""Events to one shape: cleaned and derived fields, the values that the event schema allows, checks against it, nested and flat views.

Events are the columns of ``sources.parsers.FIELDS``; what has no column is in ``extra`` under its dotted name.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions import scalar
from .matching import nested as nested_field

# Top-level domains that are often abused.
SUSPICIOUS = ("xyz", "top", "zip", "click", "tk", "ml", "ga", "cf", "gq", "onion", "ru", "su", "pw", "cc", "ws")
# What the event schema allows, and what sources write instead.
KINDS = "alert asset enrichment event metric pipeline_error signal state".split()
CATEGORIES = "api authentication configuration database driver email file host iam intrusion_detection library malware network package process registry session threat vulnerability web".split()
TYPES = "access admin allowed change connection creation deletion denied device end error group indicator info installation protocol start user".split()
OUTCOMES = "failure success unknown".split()
DIRECTIONS = "ingress egress inbound outbound internal external unknown".split()
ALIASES = {
    "category": {"auth": "authentication", "login": "authentication", "logon": "authentication", "account": "iam", "firewall": "network", "dns": "network", "ids": "intrusion_detection", "service": "configuration", "config": "configuration", "http": "web"},
    "type": {"create": "creation", "created": "creation", "delete": "deletion", "deleted": "deletion", "modify": "change", "modified": "change", "changed": "change", "deny": "denied", "blocked": "denied", "block": "denied", "allow": "allowed", "information": "info", "stop": "end", "stopped": "end", "started": "start", "install": "installation"},
    "outcome": {"ok": "success", "succeeded": "success", "successful": "success", "allowed": "success", "fail": "failure", "failed": "failure", "error": "failure", "denied": "failure"},
}
ALLOWED = {"category": CATEGORIES, "type": TYPES, "outcome": OUTCOMES}
# The schema's field sets and base fields, and the field sets of our own.
FIELD_SETS = frozenset(
    "agent as client cloud code_signature container data_stream destination device dll dns ecs elf email error event faas file geo group hash host http interface log macho network observer orchestrator organization os package pe process registry related risk rule server service source threat tls tracing url user user_agent vlan volume vulnerability x509".split()
) | frozenset("palisade winlog sysmon powershell auditd dhcp fail2ban cron systemd journald syslog nginx apache json labels".split())
BASE_FIELDS = frozenset(("@timestamp", "labels", "message", "tags"))
# The dotted names of the event's columns.
NAMES = {
    "ts": "@timestamp", "dataset": "event.dataset", "host": "host.name", "program": "process.name", "pid": "process.pid", "code": "event.code", "category": "event.category", "type": "event.type", "action": "event.action", "outcome": "event.outcome", "severity": "event.severity",
    "user": "user.name", "domain": "user.domain", "target_user": "user.target.name", "source_ip": "source.ip", "source_port": "source.port", "destination_ip": "destination.ip", "destination_port": "destination.port", "message": "message", "tags": "tags",
}
HASHES = ("process.hash.md5", "process.hash.sha1", "process.hash.sha256", "file.hash.md5", "file.hash.sha1", "file.hash.sha256")


def field_of(name: str) -> Column:
    """An event's field by its dotted name."""
    own = {v: k for k, v in NAMES.items()}
    return F.col(own[name]) if name in own else F.col("extra")[name]


def resolver(events: DataFrame) -> Callable[[str], Column]:
    """Fields of parsed events by their dotted names: a column of that name, the event's own columns, structs, then what is in ``extra``."""
    own, columns, look = {v: k for k, v in NAMES.items()}, set(events.columns), nested_field(events.schema)

    def column(name: str) -> Column:
        if name not in columns and own.get(name) in columns:
            return F.col(own[name])
        if name in columns or "extra" not in columns:
            return look(name)
        return F.col("extra")[name]

    return column


def canonical(kind: str, value: Column) -> Column:
    """The allowed value that a source means, or the value in lower case if there is none."""
    plain = F.translate(F.lower(F.trim(value)), "- ", "__")
    table = F.create_map(*[F.lit(x) for pair in ALIASES[kind].items() for x in pair])
    return F.when(plain.isin(*ALLOWED[kind]), plain).otherwise(F.coalesce(table[plain], F.lower(F.trim(value))))


def _put(extra: Column, **given: Column) -> Column:
    """extra with fields set where they are not null; ``__`` in a name stands for a dot."""
    new = F.map_from_entries(F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(k.replace("__", ".")).alias("key"), c.cast("string").alias("value"))) for k, c in given.items()])))
    old = F.coalesce(extra, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return scalar.let(new, lambda n: F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(n, k)), n))


def normalised(events: DataFrame, offset_hours: float = 0.0, opens: int = 8, closes: int = 19) -> DataFrame:
    """Events with trimmed lower-case names of hosts and programs, users cut from their domains, checked addresses (a bad one moves to
    ``*.address``), cut command lines, registered domains, local times, and the schema's values; tags and related fields follow.  No row goes.
    """
    value = lambda n: F.col("extra")[n]
    user = scalar.user_parts(F.trim("user"))
    cut = F.col("domain").isNull()
    good = lambda c: scalar.ip_key(F.col(c)).isNotNull()
    plain = lambda c: F.when(good(c), F.regexp_replace(F.lower(c), "^::ffff:(?=[0-9.]+$)", ""))
    asked = F.regexp_replace(F.lower(value("dns.question.name")), r"\.+$", "")
    domain = F.when(asked.rlike(r"^[a-z0-9.-]+\.[a-z]{2,}$"), scalar.registered_domain(asked))
    args = scalar.arguments(value("process.command_line"))
    own = lambda n, p: F.coalesce(F.lower(F.trim(n)), F.lower(scalar.basename(F.trim(p))))
    one = events.withColumns(
        {
            "host": F.lower(F.trim("host")), "program": own(F.col("program"), value("process.executable")),
            "user": F.when(cut, user["name"]).otherwise(F.trim("user")), "domain": F.coalesce("domain", user["domain"]),
            "source_ip": plain("source_ip"), "destination_ip": plain("destination_ip"),
            "category": canonical("category", F.col("category")), "type": canonical("type", F.col("type")), "outcome": canonical("outcome", F.coalesce("outcome", F.lit("unknown"))),
            "__address": F.struct(F.coalesce(plain("source_ip"), "source_ip").alias("source"), F.coalesce(plain("destination_ip"), "destination_ip").alias("destination")),
            "__args": args, "__local": scalar.local_time(F.col("ts"), offset_hours, opens, closes),
        }
    )
    machine = F.coalesce(F.col("user").endswith("$") | F.col("target_user").endswith("$"), F.lit(False))
    suspicious = F.coalesce(asked.rlike(rf"\.(?:{'|'.join(SUSPICIOUS)})$"), F.lit(False))
    known = lambda *cs: scalar.ordered_distinct(*[F.array(c) for c in cs])
    joined = lambda a: F.when(F.size(a) > 0, F.array_join(a, ","))
    version = F.coalesce(scalar.ip_version(F.col("source_ip")), scalar.ip_version(F.col("destination_ip")))
    extra = _put(
        F.col("extra"), source__address=F.col("__address.source"), destination__address=F.col("__address.destination"), network__type=F.coalesce(value("network.type"), F.when(version.isNotNull(), F.concat(F.lit("ipv"), version.cast("string")))),
        process__args=F.when(F.size("__args.args") > 0, F.to_json("__args.args")), process__args_count=F.when(F.size("__args.args") > 0, F.col("__args.n")), process__parent__name=own(value("process.parent.name"), value("process.parent.executable")),
        dns__question__name=asked, dns__question__registered_domain=domain, dns__question__top_level_domain=F.when(domain.isNotNull(), F.substring_index(asked, ".", -1)),
        palisade__time__hour=F.col("__local.hour"), palisade__time__weekday=F.col("__local.weekday"), palisade__time__business_hours=F.when(F.col("ts").isNotNull(), F.col("__local.business_hours")),
        related__ip=joined(scalar.ordered_distinct(F.array("source_ip"), F.array("destination_ip"), F.array(value("host.ip")), F.array(value("client.ip")), F.split(value("related.ip"), ","))), related__user=joined(known(F.col("user"), F.col("target_user"), value("user.effective.name"))),
        related__hosts=joined(known(F.col("host"), F.lower(value("source.domain")), F.lower(value("destination.domain")))), related__hash=joined(known(*[value(h) for h in HASHES])), ecs__version=F.lit("8.11.0"), event__kind=F.coalesce(value("event.kind"), F.lit("event")),
    )
    tags = scalar.with_tag(scalar.with_tag(F.col("tags"), "machine-account", machine), "suspicious-tld", suspicious)
    return one.withColumn("extra", extra).withColumn("tags", tags).drop("__address", "__args", "__local")


def problems(events: DataFrame, most: int = 10) -> DataFrame:
    """events with ``problems``: what the schema objects to (at most ``most`` of them), and the tag ``schema-problem`` where there are any."""
    value = lambda n: F.col("extra")[n]
    says = []

    def say(bad: Column, *text: str | Column) -> None:
        says.append(F.when(F.coalesce(bad, F.lit(False)), F.concat(*[F.lit(t) if isinstance(t, str) else F.coalesce(t.cast("string"), F.lit("null")) for t in text])))

    say(F.col("ts").isNull(), "@timestamp is missing")
    say(value("ecs.version").isNull(), "ecs.version is missing")
    for c, allowed in ALLOWED.items():
        say(~F.col(c).isin(*allowed), f"event.{c}: ", F.col(c), " is not allowed")
    say(~value("event.kind").isin(*KINDS), "event.kind: ", value("event.kind"), " is not allowed")
    for name, c in (("event.kind", value("event.kind")), ("event.outcome", F.col("outcome")), ("event.dataset", F.col("dataset"))):
        say(c.isNull() | (c == ""), f"{name} is missing")
    say(~value("network.direction").isin(*DIRECTIONS), "network.direction: ", value("network.direction"))
    for name, c in (("source.ip", F.col("source_ip")), ("destination.ip", F.col("destination_ip")), ("client.ip", value("client.ip")), ("server.ip", value("server.ip"))):
        say(c.isNotNull() & scalar.ip_key(c).isNull(), f"{name}: ", c, " is no address")
    for name in ("process.parent.pid", "http.response.status_code", "http.response.body.bytes", "winlog.record_id"):
        say(value(name).isNotNull() & scalar.to_int(value(name)).isNull(), f"{name}: ", value(name), " is no integer")
    for side in ("source", "destination"):
        say(~value(f"{side}.geo.country_iso_code").rlike("^[A-Z]{2}$"), f"{side}.geo.country_iso_code: ", value(f"{side}.geo.country_iso_code"))
    odd = F.filter(F.map_keys("extra"), lambda k: ~F.substring_index(k, ".", 1).isin(*FIELD_SETS) & ~k.isin(*BASE_FIELDS))
    found = F.concat(F.array_compact(F.array(*says)), F.transform(odd, lambda k: F.concat(k, F.lit(": no field set of the schema"))))
    out = events.withColumn("problems", F.slice(F.coalesce(found, F.array_compact(F.array(*says))), 1, most))
    return out.withColumn("tags", scalar.with_tag(F.col("tags"), "schema-problem", F.size("problems") > 0))


def _tree(names: dict[str, Column]) -> Column:
    """A struct of structs by the parts of dotted names; where a name is also the start of another, its own value is ``value``."""
    heads: dict[str, dict[str, Column]] = {}
    for name, c in names.items():
        head, _, rest = name.partition(".")
        heads.setdefault(head, {})[rest] = c
    fields = []
    for head, inner in sorted(heads.items()):
        if set(inner) == {""}:
            fields.append(inner[""].alias(head))
        else:
            own = {"value": inner.pop("")} if "" in inner else {}
            fields.append(_tree(own | inner).alias(head))
    return F.struct(*fields)


def nested(events: DataFrame, names: list[str]) -> DataFrame:
    """(doc): the fields of the names as one nested struct; category and type are arrays in it."""
    many = ("event.category", "event.type")
    return events.select(_tree({n: F.when(field_of(n).isNotNull(), F.array(field_of(n))) if n in many else field_of(n) for n in names}).alias("doc"))


def flattened(df: DataFrame) -> DataFrame:
    """Nested structs as columns with dotted names."""

    def leaves(kind: StructType, path: tuple[str, ...]) -> list[tuple[str, ...]]:
        return [x for f in kind.fields for x in (leaves(f.dataType, (*path, f.name)) if isinstance(f.dataType, StructType) else [(*path, f.name)])]

    return df.select(*[F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path)) for path in leaves(df.schema, ())])


def unflattened(df: DataFrame) -> DataFrame:
    """Columns with dotted names as nested structs."""
    return df.select(_tree({c: F.col(f"`{c}`") for c in df.columns}).alias("__d")).select("__d.*")


def stored(events: DataFrame, hot: list[str]) -> DataFrame:
    """The columns of the event store: ``hot`` ones as they are, lists and structs among them as JSON, and the whole event as JSON in ``doc``."""
    kinds = {f.name: f.dataType for f in events.schema.fields}
    col = lambda c: F.to_json(c).alias(c) if isinstance(kinds[c], ArrayType | StructType) else F.col(c)
    return events.select(*map(col, hot), F.to_json(F.struct(*[F.col(f"`{c}`") for c in events.columns])).alias("doc"))


def catalogue(spark, names: list[str]) -> DataFrame:
    """(field, ecs): fields, and whether the public schema has them."""
    own = frozenset("palisade winlog sysmon powershell auditd dhcp fail2ban cron systemd journald syslog nginx apache json".split())
    return spark.createDataFrame([(n, n.split(".")[0] not in own and (n in BASE_FIELDS or n.split(".")[0] in FIELD_SETS)) for n in sorted(names)], "field string, ecs boolean")


def kept(events: DataFrame, dropped: tuple[str, ...] = ()) -> DataFrame:
    """Events of no dropped dataset (or one below it)."""
    gone = [(F.lower("dataset") == d.lower()) | F.lower("dataset").startswith(d.lower() + ".") for d in dropped]
    return events.where(~F.coalesce(reduce(lambda a, b: a | b, gone), F.lit(False))) if gone else events


def counters(events: DataFrame, received: int | None = None) -> DataFrame:
    """(counter, n): events by parser, by tag of the pipeline, and all; with ``received`` lines, how many were dropped."""
    by = events.groupBy(F.concat(F.lit("parsed."), F.coalesce("parser", F.lit("none"))).alias("counter")).agg(F.count(F.lit(1)).alias("n"))
    tags = events.select(F.explode("tags").alias("counter")).where(F.col("counter").isin("schema-problem", "machine-account", "suspicious-tld")).groupBy("counter").agg(F.count(F.lit(1)).alias("n"))
    total = events.agg(F.count(F.lit(1)).alias("n"))
    out = by.union(tags).union(total.select(F.lit("emitted"), "n"))
    return out if received is None else out.union(total.select(F.lit("dropped"), F.lit(received).cast("long") - F.col("n")))


def parser_coverage(events: DataFrame) -> DataFrame:
    """(dataset, n, specific): events of each dataset, and the share that another parser than the generic one read."""
    return events.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("parser") != "generic").cast("double")).alias("specific"))
