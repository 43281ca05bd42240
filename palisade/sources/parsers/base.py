"""What the parsers share: the event's fields, parts of a line by one pattern, first match of a list of patterns."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions.scalar import timestamp

#: The event's columns.  What has no column of its own is in ``extra`` under its dotted name.
FIELDS = {
    "parser": "string", "dataset": "string", "ts": "timestamp", "host": "string", "program": "string", "pid": "bigint", "code": "string", "category": "string", "type": "string",
    "action": "string", "outcome": "string", "severity": "string", "user": "string", "domain": "string", "target_user": "string", "source_ip": "string", "source_port": "bigint",
    "destination_ip": "string", "destination_port": "bigint", "message": "string", "tags": "array<string>", "extra": "map<string,string>",
}
SEPARATOR = "\u0001"
#: Characters of an original line that are looked at as a message.
LONGEST = 32_768


@dataclass
class Clock:
    year: int
    now: Column | None = None

    def time(self, text: Column) -> Column:
        return timestamp(text, self.year, self.now)


@dataclass
class Parser:
    """sniff: cheap test that a line is its own; head: the line's parts; more: further columns made of the parts; body: the fields of the parts."""

    name: str
    sniff: Callable[[Column], Column]
    head: Callable[[Column], Column]
    body: Callable[..., dict[str, Column]]
    more: list[Callable[..., Column]] = field(default_factory=list)

    def event(self, line: Column, clock: Clock, *parts: Column) -> Column:
        given = {"parser": F.lit(self.name), "outcome": F.lit("unknown"), "message": F.substring(line, 1, LONGEST), **self.body(line, clock, *parts)}
        if unknown := set(given) - set(FIELDS):
            raise ValueError(f"{self.name}: no field {sorted(unknown)[0]}")
        return F.struct(*[given.get(k, F.lit(None)).cast(t).alias(k) for k, t in FIELDS.items()])


def parts(text: Column, pattern: str, n: int) -> Column:
    """The n groups of a pattern that spans the whole text, as an array, in one pass; null where it does not fit.  A group that took no part is empty."""
    whole = f"(?s)^{pattern}$"
    marked = F.regexp_replace(text, whole, SEPARATOR.join(f"${i}" for i in range(1, n + 1)))
    return F.when(marked != text, F.split(marked, SEPARATOR, n)) if n > 1 else F.when(text.rlike(whole), F.array(marked))


def at(array: Column, i: int) -> Column:
    """Part i, from 0 on; null if it is empty."""
    return F.nullif(F.get(array, F.lit(i)), F.lit(""))


def first_match(text: Column, patterns: list[str]) -> Column:
    """The number of the first pattern that is found, or null."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(i)) for i, p in enumerate(patterns)], F.lit(None).cast("int"))


def group_of(text: Column, which: Column, patterns: list[str], groups: list[int | None]) -> Column:
    """The group that the pattern found has for a field (None: it has none); null if empty."""
    out = F.lit(None).cast("string")
    for i, (p, g) in enumerate(zip(patterns, groups, strict=True)):
        if g is not None:
            out = F.when(which == i, F.regexp_extract(text, p, g)).otherwise(out)
    return F.nullif(out, F.lit(""))


def chosen(which: Column, values: list[str | None]) -> Column:
    """The value at a number from 0 on."""
    return F.get(F.from_json(F.lit(json.dumps(values)), "array<string>"), which)


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The table's text for a key.  The table is one literal, which Spark folds to a map when it plans."""
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")[key]


def extras(**given: Column) -> Column:
    """map of what is neither null nor empty; ``__`` in a name stands for a dot."""
    names = F.from_json(F.lit(json.dumps([k.replace("__", ".") for k in given])), "array<string>")
    return F.map_filter(F.map_from_arrays(names, F.array(*[c.cast("string") for c in given.values()])), lambda _, v: v != "")
