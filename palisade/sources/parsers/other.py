"""JSON lines that are documents of the event schema, and whatever is left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions.scalar import key_values, to_int
from .base import Parser, extras
from .windows import flattened


def _json(line: Column, clock, doc: Column) -> dict[str, Column]:
    dotted = lambda *names: F.coalesce(*[F.nullif(doc[n], F.lit("")) for n in names])
    return {
        "ts": clock.time(dotted("@timestamp", "timestamp", "time")), "dataset": F.coalesce(dotted("event.dataset"), F.lit("json")), "host": dotted("host.name"), "program": dotted("process.name"), "pid": to_int(dotted("process.pid")), "code": dotted("event.code"), "category": dotted("event.category"), "type": dotted("event.type"),
        "action": dotted("event.action"), "outcome": F.coalesce(dotted("event.outcome"), F.lit("unknown")), "severity": dotted("event.severity"), "user": dotted("user.name"), "domain": dotted("user.domain"), "target_user": dotted("user.target.name"), "source_ip": dotted("source.ip"), "source_port": to_int(dotted("source.port")),
        "destination_ip": dotted("destination.ip"), "destination_port": to_int(dotted("destination.port")), "message": F.coalesce(dotted("message", "msg"), F.substring(line, 1, 1000)), "tags": F.coalesce(F.from_json(doc["tags"], "array<string>"), F.when(doc["tags"].isNotNull(), F.array(doc["tags"]))), "extra": doc,
    }


#: Records of a journal or of Windows are other parsers'.
JSON = Parser("json", lambda line: line.rlike(r"^\s*\{") & ~line.rlike(r'"MESSAGE"\s*:|"winlog(?:\.event_id|\.channel|"\s*:)') & F.from_json(line, "map<string,string>").isNotNull(), flattened, _json)


def _generic(line: Column, clock, kv: Column) -> dict[str, Column]:
    level = F.lower(F.regexp_extract(line, r"(?i)\b(debug|info|notice|warn(?:ing)?|error|critical|fatal)\b", 1))
    ips = F.regexp_extract_all(line, F.lit(r"\b(\d{1,3}(?:\.\d{1,3}){3})\b"), F.lit(1))
    return {
        "dataset": F.lit("generic"), "ts": clock.time(F.regexp_extract(line, r"(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d\S*)", 1)), "category": F.lit("host"), "type": F.lit("info"), "action": F.lit("generic-message"), "source_ip": F.get(ips, F.lit(0)), "destination_ip": F.get(ips, F.lit(1)),
        "extra": F.map_concat(F.map_filter(kv, lambda k, _: ~k.isin("log.level", "related.ip")), extras(log__level=level, related__ip=F.array_join(F.array_distinct(ips), ","))),
    }


GENERIC = Parser("generic", lambda line: F.lit(True), key_values, _generic)
