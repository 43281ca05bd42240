"""Detection predicates: selections with modifiers, and conditions over selections.  All of them are true or false, never null."""

from __future__ import annotations

import fnmatch
import ipaddress
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, MapType, StructType

from ..functions.scalar import in_cidr
from ..plans.boolean_text import folded

# The modifiers of the rule format.
MODIFIERS = frozenset("contains startswith endswith re cs cidr gt gte lt lte exists all not wildcard".split())


#: Where a bare text is looked for, those of them that there are.
TEXT_FIELDS = ("message", "event.original", "process.command_line")


class RuleError(ValueError):
    pass


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def one(x: Column, expected: object, mods: set[str]) -> Column:
    """One scalar field against one expected value."""
    if "exists" in mods:
        return x.isNotNull() == F.lit(bool(expected))
    if expected is None:
        return x.isNull()
    text = x.cast("string")
    for name, op in (("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
        if name in mods:
            n = F.when(F.typeof(x) != "boolean", x.try_cast("double"))  # a truth value is no number
            return _sure({">": n > float(expected), ">=": n >= float(expected), "<": n < float(expected), "<=": n <= float(expected)}[op])
    if "cidr" in mods:
        return in_cidr(text, str(expected))
    if "re" in mods:
        return _sure(text.rlike(("" if "cs" in mods else "(?iu)") + str(expected)))
    if isinstance(expected, int | float) and not isinstance(expected, bool) and not mods - {"cs", "all", "not"}:
        # As text, or as numbers where the field has any: 7 is 7.0 there, but "07" is not 7 in a text.
        return _sure((text == str(expected)) | F.when(F.typeof(x) != "string", x.try_cast("double") == float(expected)))
    if isinstance(expected, bool):
        return _sure(F.lower(text).isin(*(("true", "1") if expected else ("false", "0"))))
    cs = "cs" in mods
    left, want = (text if cs else F.lower(text)), (str(expected) if cs else str(expected).lower())
    if "contains" in mods:
        return _sure(left.contains(want))
    if "startswith" in mods:
        return _sure(left.startswith(want))
    if "endswith" in mods:
        return _sure(left.endswith(want))
    if re.search(r"[*?]", want):
        pattern = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in want)
        return _sure(left.rlike(f"^{pattern}$"))
    return _sure(left == want)


def _together(values: list, mods: set[str]) -> Callable[[Column], Column] | None:
    """Many plain texts looked for at once: as one set, or as one pattern of alternatives.  None where they are not all plain, or must all be there."""
    if not all(isinstance(v, str) for v in values) or mods - {"contains", "startswith", "endswith", "cs", "not"} or (not mods & {"contains", "startswith", "endswith"} and any(re.search(r"[*?]", v) for v in values)):
        return None
    want = list(dict.fromkeys(v if "cs" in mods else v.lower() for v in values))
    text = (lambda x: x.cast("string")) if "cs" in mods else (lambda x: F.lower(x.cast("string")))
    if not mods & {"contains", "startswith", "endswith"}:
        return lambda x: _sure(text(x).isin(*want))
    any_of = "(?:" + "|".join(map(re.escape, want)) + ")"
    pattern = any_of if "contains" in mods else rf"^{any_of}" if "startswith" in mods else rf"{any_of}\z"
    return lambda x: _sure(text(x).rlike(pattern))


def field_test(key: str, expected: object, column: Callable[[str], Column], lists: frozenset[str] = frozenset()) -> Column:
    """``name|mod|mod: value or [values]``; several values mean any of them, or all with the modifier ``all``."""
    name, *mods = key.split("|")
    if unknown := set(mods) - MODIFIERS:
        raise RuleError(f"unknown modifier {sorted(unknown)[0]}")
    x, mods = column(name), set(mods)
    values = expected if isinstance(expected, list) else [expected]
    if len(values) > 1 and (together := _together(values, mods)):
        out = _sure(F.exists(x, together)) if name in lists else together(x)
        return ~out if "not" in mods else out
    if name in lists:
        test = lambda v: (x.isNull() | (F.size(x) == 0)) if v is None else _sure(F.exists(x, lambda e: one(e, v, mods)))
    else:
        test = lambda v: one(x, v, mods)
    out = reduce((lambda a, b: a & b) if "all" in mods else (lambda a, b: a | b), map(test, values)) if values else F.lit(False)
    return ~out if "not" in mods else out


def selection(spec: object, column: Callable[[str], Column], lists: frozenset[str] = frozenset(), text_fields: tuple[str, ...] = TEXT_FIELDS) -> Column:
    """A mapping (all of it), a list (any of it) or a bare text (contained in a text field)."""
    if isinstance(spec, dict):
        return reduce(lambda a, b: a & b, [field_test(k, v, column, lists) for k, v in spec.items()], F.lit(True))
    if isinstance(spec, list):
        return reduce(lambda a, b: a | b, [selection(s, column, lists, text_fields) for s in spec], F.lit(False))
    return reduce(lambda a, b: a | b, [one(column(f), spec, {"contains"}) for f in text_fields])


def condition(text: str, selections: dict[str, Column]) -> Column:
    """and / or / not / ( ) over names, ``N of pattern``, ``all of pattern`` and ``them``; empty: all selections."""
    if not text.strip():
        return reduce(lambda a, b: a & b, selections.values())

    def piece(m: re.Match) -> str | Column:
        if m["of"] is None:
            word = m["word"].lower()
            if word in ("and", "or", "not", "(", ")"):
                return word
            if m["word"] not in selections:
                raise RuleError(f"unknown selection {m['word']}")
            return selections[m["word"]]
        found = [c for n, c in selections.items() if m["of"].lower() == "them" or fnmatch.fnmatchcase(n, m["of"])]
        if not found:
            raise RuleError(f"{m['of']} names no selection")
        if m["many"].lower() == "all":
            return reduce(lambda a, b: a & b, found)
        return reduce(lambda a, b: a + b, [c.cast("int") for c in found]) >= int(m["many"])

    pieces = [piece(m) for m in re.finditer(r"(?P<many>\d+|(?i:all))\s+(?i:of)\s+(?P<of>[^\s()]+)|(?P<word>[()]|[^\s()]+)", text)]
    try:
        return folded(pieces)
    except ValueError as e:
        raise RuleError(str(e)) from None


def nested(columns: list[str] | StructType) -> Callable[[str], Column]:
    """A field by its dotted name: the flat column of that name if there is one, else the struct fields along the name, or the entry of a map, else null.

    With the schema, names that lead through a column without such fields are null; with names alone, that is an error when the plan is made.
    """
    known = set(columns.names if isinstance(columns, StructType) else columns)

    def inside(kind: DataType, parts: list[str]) -> bool:
        for i, p in enumerate(parts):
            if isinstance(kind, MapType):
                return i == len(parts) - 1
            if not isinstance(kind, StructType) or p not in kind.names:
                return False
            kind = kind[p].dataType
        return True

    def column(name: str) -> Column:
        if name in known:
            return F.col(f"`{name}`")
        parts = name.split(".")
        for i in range(len(parts) - 1, 0, -1):
            if (head := ".".join(parts[:i])) in known and (not isinstance(columns, StructType) or inside(columns[head].dataType, parts[i:])):
                return F.col(".".join([f"`{head}`", *[f"`{p}`" for p in parts[i:]]]))
        return F.lit(None).cast("string")

    return column


def check(spec: object) -> list[str]:
    """What is wrong with a selection, before it meets any data."""
    if isinstance(spec, list):
        return [p for s in spec for p in check(s)]
    if not isinstance(spec, dict):
        return [] if isinstance(spec, str) else [f"{spec!r} is neither a mapping, a list nor a text"]
    out = []
    for key, expected in spec.items():
        name, *mods = str(key).split("|")
        out += [f"{name}: unknown modifier {m}" for m in mods if m not in MODIFIERS]
        for v in expected if isinstance(expected, list) else [expected]:
            if isinstance(v, list | dict):
                out.append(f"{name}: {v!r} is no single value")
            elif "cidr" in mods:
                try:
                    ipaddress.ip_network(str(v), strict=False)
                except ValueError:
                    out.append(f"{name}: {v!r} is no network")
            elif "re" in mods:
                try:
                    re.compile(str(v))
                except re.error as e:
                    out.append(f"{name}: {v!r} is no pattern ({e})")
            elif set(mods) & {"gt", "gte", "lt", "lte"}:
                try:
                    float(v)
                except (TypeError, ValueError):
                    out.append(f"{name}: {v!r} is no number")
    return out


def source_filter(x: Column, wanted: str | list[str]) -> Column:
    """Equal to one of the wanted names, or below it in a dotted name, in any case."""
    names = [w.lower() for w in ([wanted] if isinstance(wanted, str) else map(str, wanted))]
    return _sure(reduce(lambda a, b: a | b, [(F.lower(x) == w) | F.lower(x).startswith(w + ".") for w in names]))
