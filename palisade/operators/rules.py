"""Detection rules (YAML): loaded and checked on the driver, compiled to Columns, run over a table of events."""

from __future__ import annotations

import glob
import os
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import SEVERITIES, duration
from . import detection, matching

# Where the parts of a log source are found in an event, and how long a rule is quiet after an alert, in seconds.
SOURCES = {"dataset": "event.dataset", "module": "event.module", "category": "event.category", "product": "host.os.type", "service": "event.dataset"}
SUPPRESS = 600.0


@dataclass
class Rule:
    id: str
    title: str
    severity: str = "medium"
    description: str = ""
    enabled: bool = True
    logsource: dict = field(default_factory=dict)
    detection: dict = field(default_factory=dict)
    threshold: dict | None = None
    sequence: dict | None = None
    group_by: list[str] = field(default_factory=list)
    window: float = 60.0
    suppress: float = SUPPRESS
    tags: list[str] = field(default_factory=list)
    mitre: list[dict] = field(default_factory=list)
    playbook: str = ""
    falsepositives: list[str] = field(default_factory=list)

    @property
    def kind(self) -> str:
        return "sequence" if self.sequence else "threshold" if self.threshold or self.group_by else "match"

    @property
    def score(self) -> int:
        return SEVERITIES.get(self.severity, SEVERITIES["medium"])

    @property
    def groups(self) -> list[str]:
        """The fields by which events are counted: the sequence's, the threshold's, or the rule's own."""
        return _names((self.sequence or {}).get("by")) or _names((self.threshold or {}).get("group_by")) or self.group_by

    def public(self) -> dict:
        """What a list of rules shows of it."""
        shown = {k: getattr(self, k) for k in ("id", "title", "severity", "description", "enabled", "tags", "mitre", "logsource", "kind", "threshold", "suppress", "playbook", "falsepositives")}
        stages = [{"name": s.get("name", f"stage{i}"), "count": int(s.get("count", 1))} for i, s in enumerate((self.sequence or {}).get("stages", []), 1)]
        return shown | {"condition": str(self.detection.get("condition", "")), "sequence": {"by": self.groups, "within": self.sequence.get("within", "10m"), "stages": stages} if self.sequence else None}


def _names(value: object) -> list[str]:
    return [value] if isinstance(value, str) else [str(v) for v in value or []]


def load(directory: str, strict: bool = False, renamed: dict[str, str] | None = None) -> list[Rule]:
    """All rules below a directory, sorted by id; a later rule with a known id is skipped, or an error if strict.

    ``renamed``: beginnings of field names that a pack uses, and what they are called here (a vendor's name space, ``{"vendor.": "palisade."}``).
    """
    import yaml

    out: dict[str, Rule] = {}
    for path in sorted(p for ext in ("yml", "yaml") for p in glob.glob(os.path.join(directory, "**", f"*.{ext}"), recursive=True)):
        with open(path, encoding="utf-8") as f:
            for doc in filter(None, yaml.safe_load_all(f)):
                rule = from_dict(_renamed(doc, renamed) if renamed else doc)
                if rule.id in out and strict:
                    raise matching.RuleError(f"{path}: {rule.id} exists already")
                out.setdefault(rule.id, rule)
    return [out[k] for k in sorted(out)]


def _renamed(spec: object, names: dict[str, str]) -> object:
    """Keys, and fields that are named as values, with their beginnings replaced; other texts stay."""

    def name(text: object) -> object:
        return next((new + text[len(old) :] for old, new in names.items() if isinstance(text, str) and text.startswith(old)), text)

    if isinstance(spec, dict):
        named = ("group_by", "by", "distinct", "dataset")
        return {name(k): ([name(x) for x in v] if isinstance(v, list) else name(v)) if k in named else _renamed(v, names) for k, v in spec.items()}
    return [_renamed(x, names) for x in spec] if isinstance(spec, list) else spec


def problems(doc: dict) -> list[str]:
    """All that is wrong with a rule."""
    out = [f"a rule needs {key}" for key in ("id", "title") if not doc.get(key)]
    if str(doc.get("severity", "medium")).lower() not in SEVERITIES:
        out.append(f"unknown severity {doc['severity']}")
    detect, sequence, threshold = doc.get("detection"), doc.get("sequence"), doc.get("threshold")
    if not detect and not sequence:
        out.append("nothing to detect")

    def timed(where: str, text: object, least: float = 0.0) -> None:
        try:
            if duration(text) < least:
                out.append(f"{where} must be over 0")
        except ValueError as e:
            out.append(f"{where}: {e}")

    if detect is not None and not isinstance(detect, dict):
        out.append("detection must be a mapping")
    elif detect:
        chosen = {k: v for k, v in detect.items() if k != "condition"}
        out += [f"{k}: {p}" for k, v in chosen.items() for p in matching.check(v)]
        if not chosen:
            out.append("detection needs a selection")
        else:
            out += _condition_problem(str(detect.get("condition") or ""), list(chosen))
    if threshold is not None:
        if not isinstance(threshold, dict):
            out.append("threshold must be a mapping")
        else:
            if not str(threshold.get("count", 1)).isdigit() or int(threshold.get("count", 1)) < 1:
                out.append("threshold.count must be a number from 1 on")
            timed("threshold.window", threshold.get("window", "5m"), 1e-6)
    if sequence is not None:
        stages = sequence.get("stages") if isinstance(sequence, dict) else None
        if not isinstance(stages, list) or len(stages) < 2:
            out.append("sequence needs two stages or more")
        else:
            out += [f"stage {i}: {p}" for i, s in enumerate(stages, 1) for p in (matching.check(s["selection"]) if isinstance(s, dict) and "selection" in s else ["it needs a selection"])]
            timed("sequence.within", sequence.get("within", "10m"))
    if doc.get("suppress") is not None:
        timed("suppress", doc["suppress"])
    if doc.get("mitre") is not None and not isinstance(doc["mitre"], list):
        out.append("mitre must be a list")
    return out


def _condition_problem(text: str, names: list[str]) -> list[str]:
    if not text.strip():
        return []
    try:
        matching.condition(text, {n: F.lit(True) for n in names})
    except matching.RuleError as e:
        return [f"condition: {e}"]
    return []


def from_dict(doc: dict) -> Rule:
    if found := problems(doc):
        raise matching.RuleError(f"{doc.get('id', '?')}: {'; '.join(found)}")
    known = {k: doc[k] for k in ("logsource", "detection", "threshold", "sequence") if doc.get(k)}
    texts = {k: str(doc[k]).strip() for k in ("id", "title", "description", "playbook") if doc.get(k)}
    lists = {k: _names(doc[k]) for k in ("tags", "falsepositives") if doc.get(k)}
    mitre = [{"technique": m} if isinstance(m, str) else {k: str(v) for k, v in m.items()} for m in doc.get("mitre") or []]
    quiet = SUPPRESS if doc.get("suppress") is None else duration(doc["suppress"])
    return Rule(**known, **texts, **lists, mitre=mitre, severity=str(doc.get("severity", "medium")).lower(), enabled=bool(doc.get("enabled", True)), group_by=_names(doc.get("group_by")), window=duration(doc.get("window", "1m")), suppress=quiet)


def predicate(rule: Rule, column: Callable[[str], Column], lists: frozenset[str] = frozenset()) -> Column:
    chosen = {k: matching.selection(v, column, lists) for k, v in rule.detection.items() if k != "condition"}
    out = matching.condition(str(rule.detection.get("condition") or ""), chosen)
    for k, v in rule.logsource.items():
        out = matching.source_filter(column(SOURCES.get(k, k)), v) & out
    return out


def group_key(names: list[str], column: Callable[[str], Column], lists: frozenset[str] = frozenset()) -> Column:
    """``f1=v1|f2=v2``; a missing value is empty, a list is joined by commas, no names give ``*``."""
    text = lambda n: F.array_join(column(n), ",") if n in lists else column(n).cast("string")
    return F.concat_ws("|", *[F.concat(F.lit(f"{n}="), F.coalesce(text(n), F.lit(""))) for n in names]) if names else F.lit("*")


def alerts(rule: Rule, events: DataFrame, ts: str, event_id: str, column: Callable[[str], Column], lists: frozenset[str] = frozenset(), exact: bool = True) -> DataFrame:
    """(rule_id, group_key, first_seen, last_seen, count) of a rule over history.

    A match or a count of one is only grouped (no key goes to one task); a threshold is a fold by key; a sequence looks at its stages only,
    whatever logsource and detection say.  ``exact`` as in ``detection.sequence_alerts``.
    """
    key = group_key(rule.groups, column, lists)
    if rule.kind == "sequence":
        stages = [(matching.selection(s["selection"], column, lists), int(s.get("count", 1))) for s in rule.sequence["stages"]]
        ends = detection.sequence_alerts(events.withColumn("group_key", key), "group_key", ts, event_id, stages, duration(rule.sequence.get("within", "10m")), exact)
        found = detection.alert_sessions(ends.withColumnRenamed("ts", "at"), "group_key", "at", rule.suppress, F.col("n"))
    else:
        t = rule.threshold or {"count": 1, "window": rule.window}
        rows, n = events.where(predicate(rule, column, lists)).withColumn("group_key", key), int(t.get("count", 1))
        if n == 1:
            found = detection.alert_sessions(rows.select("group_key", F.col(ts).alias("at")), "group_key", "at", rule.suppress, F.lit(1))
        else:
            found = detection.threshold_alerts(rows, "group_key", ts, event_id, n, duration(t.get("window", "5m")), rule.suppress, column(t["distinct"]) if t.get("distinct") else None)
    return found.select(F.lit(rule.id).alias("rule_id"), "group_key", "first_seen", "last_seen", "count")


def all_alerts(rules: Iterable[Rule], events: DataFrame, ts: str, event_id: str, column: Callable[[str], Column], lists: frozenset[str] = frozenset()) -> DataFrame:
    """The alerts of all enabled rules, in one pass.  A rule that cannot be compiled against the events is left out and listed in ``failed`` of the result."""
    from . import rule_pack

    found = rule_pack.alerts(list(rules), events, ts, event_id, column, lists)
    out = found.select("rule_id", "group_key", "first_seen", "last_seen", "count")
    out.failed = found.failed
    return out


def matches(rules: Iterable[Rule], events: DataFrame, column: Callable[[str], Column], lists: frozenset[str] = frozenset()) -> DataFrame:
    """events with ``rules``: the ids of all enabled rules whose predicate holds, in one pass over the events."""
    tests = [F.when(predicate(r, column, lists), F.lit(r.id)) for r in rules if r.enabled and r.kind != "sequence"]
    return events.withColumn("rules", F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>"))


def dry_run(rule: Rule, events: DataFrame, ts: str, event_id: str, column: Callable[[str], Column], lists: frozenset[str] = frozenset()) -> tuple[DataFrame, DataFrame]:
    """(alerts, matched events) that a rule would give, whether it is enabled or not: nothing is suppressed, nothing is written."""
    tried = replace(rule, suppress=0.0, enabled=True)
    stages = (rule.sequence or {}).get("stages", [])
    fits = reduce(lambda a, b: a | b, [matching.selection(s["selection"], column, lists) for s in stages]) if stages else predicate(tried, column, lists)
    return alerts(tried, events, ts, event_id, column, lists), events.where(fits)


def table(spark, rules: Iterable[Rule]) -> DataFrame:
    """(id, title, severity, kind, enabled, tags) of rules, sorted by id."""
    rows = [(r.id, r.title, r.severity, r.kind, r.enabled, r.tags) for r in sorted(rules, key=lambda r: r.id)]
    return spark.createDataFrame(rows, "id string, title string, severity string, kind string, enabled boolean, tags array<string>")


def merged(shipped: DataFrame, custom: DataFrame) -> DataFrame:
    """Shipped rules and those custom ones whose id is new."""
    return shipped.unionByName(custom.join(shipped.select("id"), "id", "left_anti"))


def with_stats(rules: DataFrame, stats: DataFrame, live: DataFrame) -> DataFrame:
    """rules with stored counts (id, hits, alerts) and live hits (id, hits) added to them; 0 where there are none."""
    now = live.select("id", F.col("hits").alias("__live"))
    joined = rules.join(stats.select("id", "hits", "alerts"), "id", "left").join(now, "id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return joined.select(*rules.columns, (zero("hits") + zero("__live")).alias("hits"), zero("alerts").alias("alerts"))


def coverage(fired: DataFrame, rules: DataFrame, scenario: str = "scenario", rule: str = "rule_id") -> tuple[DataFrame, DataFrame]:
    """(scenario, rules) with each scenario's sorted rule ids, and the ids of rules that never fired."""
    by = fired.groupBy(scenario).agg(F.sort_array(F.collect_set(rule)).alias("rules"))
    return by, rules.select("id").join(fired.select(F.col(rule).alias("id")).distinct(), "id", "left_anti")
