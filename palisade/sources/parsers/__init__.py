"""Raw lines to event columns.

A parser is a ``Parser``: ``head`` says in one pass whether a line is its own and what its parts are, ``body`` turns the parts into the event's
fields.  ``parse`` works out the heads in the order that the dataset hint asks for, each only where none before has fitted, and takes the
body of the first that fits; blank lines go.  Heads are columns of a first projection, so no pattern runs once for each field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import audit, other, syslog, web, windows
from .base import FIELDS, Clock, Parser, lookup

#: In the order in which they are tried.
PARSERS: dict[str, Parser] = {p.name: p for p in (windows.XML, syslog.SYSLOG, other.JSON, audit.AUDIT, web.ERROR, web.APACHE_ERROR, web.ACCESS, windows.DHCP, windows.FIREWALL, other.GENERIC)}
#: The parser that a dataset hint asks for first.
BY_DATASET = {"linux.auth": "syslog", "linux.firewall": "syslog", "linux.fail2ban": "syslog", "syslog": "syslog", "nginx.access": "web", "apache.access": "web", "nginx.error": "web-error", "apache.error": "apache-error", "linux.auditd": "auditd", "windows.dhcp": "dhcp", "windows.firewall_log": "firewall", "linux.journald": "syslog"}


# The module of a parser's events; others tell by their dataset.
MODULES = {"windows": "windows", "dhcp": "windows", "firewall": "windows", "web": "web", "web-error": "web", "apache-error": "web", "auditd": "linux", "generic": "generic"}


def parse(lines: DataFrame, text: str, year: int, first: str | None = None, now: Column | None = None, chain: tuple[str, ...] = (), hint: str | None = None, meta: str | None = None) -> DataFrame:
    """lines with the columns of FIELDS.  ``first``: a parser or a dataset; ``now``: the clock for times without a year (else ``year``); ``chain``: the
    parsers to try, all if empty: where lines are kept by dataset, a short chain makes a small plan.

    ``hint``: a column with each line's dataset: its parser is tried first, and it names the event's dataset where the line does not tell a better one.
    ``meta``: a column with what the sender says of each line (a map, as ``sources.tables.envelopes`` gives): its host goes before the line's, all else,
    the time too, fills gaps.
    """
    first = BY_DATASET.get(first, first)
    order = sorted([p for p in PARSERS.values() if not chain or p.name in chain], key=lambda p: p.name != first)
    clock, raw = Clock(year, now), F.col("__raw")
    rows = lines.where(F.col(text).rlike(r"\S")).withColumn("__raw", F.col(text).cast("string"))
    fits = [p.sniff(raw) for p in order]
    asked = []
    if hint:
        wanted = lookup(F.lower(hint), BY_DATASET)
        asked = [F.when((wanted == p.name) & c, F.lit(i)) for i, (p, c) in enumerate(zip(order, fits, strict=True)) if p.name in BY_DATASET.values()]
    which = F.coalesce(*asked, *[F.when(c, F.lit(i)) for i, c in enumerate(fits)])
    rows = rows.withColumn("__which", which)
    rows = rows.withColumns({f"__h{i}": F.when(F.col("__which") == i, p.head(raw)) for i, p in enumerate(order)})
    for step in range(max(len(p.more) for p in order)):
        rows = rows.withColumns({f"__m{i}_{step}": F.when(F.col("__which") == i, p.more[step](F.col(f"__h{i}"), *[F.col(f"__m{i}_{k}") for k in range(step)])) for i, p in enumerate(order) if len(p.more) > step})
    bodies = [F.when(F.col("__which") == i, p.event(raw, clock, F.col(f"__h{i}"), *[F.col(f"__m{i}_{k}") for k in range(len(p.more))])) for i, p in enumerate(order)]
    rows = rows.withColumn("__e", F.coalesce(*bodies))
    made = {c: F.col(f"__e.{c}") for c in FIELDS}
    if hint:
        vague = made["parser"].isin("generic", "web", "web-error", "apache-error") | made["dataset"].isin("syslog", "json")
        made["dataset"] = F.when(vague, F.coalesce(F.col(hint), made["dataset"])).otherwise(made["dataset"])
    none = F.from_json(F.lit("{}"), "map<string,string>")
    extra = F.coalesce(made["extra"], none)
    module = F.coalesce(lookup(made["parser"], MODULES), F.when(made["parser"] == "syslog", F.when(F.col("__e.dataset") == "syslog", "syslog").otherwise("linux")), F.substring_index(made["dataset"], ".", 1))
    extra = F.when(F.map_contains_key(extra, F.lit("event.module")), extra).otherwise(F.map_concat(extra, F.create_map(F.lit("event.module"), module)))
    if meta:
        told = F.coalesce(F.col(meta), none)
        made["ts"] = F.coalesce(made["ts"], clock.time(told["@timestamp"]))
        made["host"] = F.coalesce(F.nullif(told["host.name"], F.lit("")), made["host"])
        extra = F.map_zip_with(extra, F.map_filter(told, lambda k, v: ~k.isin("@timestamp", "host.name") & (v != "")), lambda k, a, b: F.coalesce(a, b))
    made["extra"] = extra
    return rows.select(*lines.columns, *[c.alias(k) for k, c in made.items()])
