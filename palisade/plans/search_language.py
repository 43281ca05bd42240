"""Searches: boolean terms over fields, as one boolean Column.

``user.name:adm* AND NOT (event.action:login OR port:>1024) "full text"``.  AND, OR and NOT are upper case; terms side by side mean
AND.  A missing field makes a scalar term null, so NOT of it drops the row; list and full-text terms are true or false.
The terms become Columns one by one, through the functions below; what joins them is left to ``boolean_text``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .boolean_text import folded


class QueryError(ValueError):
    """The text is no query; raised before any data is read."""


@dataclass
class Fields:
    """Where fields are found.  other: a function of the names that are not listed; times: names that are given beside the query instead."""

    scalars: dict[str, Column]
    lists: dict[str, Column] = field(default_factory=dict)
    numbers: frozenset[str] = frozenset()
    tokens: Column | None = None
    other: Callable[[str], Column] | None = None
    times: frozenset[str] = frozenset({"@timestamp", "timestamp"})

    def scalar(self, name: str) -> Column:
        if name in self.scalars:
            return self.scalars[name]
        if self.other is None:
            raise QueryError(f"unknown field {name}")
        return self.other(name)


def like_pattern(value: str) -> str:
    return "".join("\\" + c if c in "%_\\" else {"*": "%", "?": "_"}.get(c, c) for c in value.lower())


# Latin letters with marks, and the letters without them.
_MARKED = "".join(chr(c) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1)
_PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _MARKED)


def unmarked(text: Column) -> Column:
    """Lower case, without the marks of Latin letters, composed or not."""
    return F.regexp_replace(F.translate(F.lower(text), _MARKED, _PLAIN), r"[̀-ͯ]", "")


def tokens_of(text: Column) -> Column:
    """Lower-case words of letters and digits without marks, for full-text terms."""
    return F.filter(F.split(unmarked(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def exists(name: str, fields: Fields) -> Column:
    return (fields.lists[name] if name in fields.lists else fields.scalar(name)).isNotNull()


def compared(name: str, op: str, number: str, fields: Fields) -> Column:
    try:
        n = float(number)
    except ValueError:
        raise QueryError(f"{name}{op} needs a number") from None
    x = fields.scalar(name).try_cast("double")
    return {">": x > n, ">=": x >= n, "<": x < n, "<=": x <= n}[op]


def equal(name: str, value: str, fields: Fields, wild: bool = True) -> Column:
    """A field that has the value in any case, or fits it with ``*`` and ``?`` if ``wild``; any element of a list does."""
    wild = wild and re.search(r"[*?]", value) is not None
    if wild and value == "*":
        return exists(name, fields)
    fits = (lambda x: F.lower(x).like(like_pattern(value))) if wild else (lambda x: F.lower(x) == value.lower())
    if name in fields.lists:
        return F.coalesce(F.exists(fields.lists[name], fits), F.lit(False))
    x = fields.scalar(name)
    if name in fields.numbers and not wild:
        try:
            return x.try_cast("double") == float(value)
        except ValueError:
            pass
    return fits(x.cast("string"))


def full_text(text: str, tokens: Column | None) -> Column:
    """All words of a text: a bare word is a token, ``word*`` the start of one, and a word with punctuation inside tokens side by side."""
    if tokens is None:
        raise QueryError("there is no full text here")
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    words = [(w, [p for p in re.split(r"[^\w]+|_", w) if p]) for w in plain.split()]
    joined = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    tests = []
    for word, found in words:
        if len(found) > 1:
            tests.append(joined.contains(" " + " ".join(found) + ("" if word.endswith("*") else " ")))
        elif found:
            tests.append(_starts(tokens, found[0]) if word.endswith("*") else F.array_contains(tokens, found[0]))
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False)) if tests else F.lit(False)


def _starts(tokens: Column, start: str) -> Column:
    return F.exists(tokens, lambda t: t.startswith(start))


# What may stand side by side in a search: a quoted text, a parenthesis, or anything up to the next blank, quote or parenthesis.
_PIECES = re.compile(r'"(?:[^"\\]|\\.)*"|[()]|[^\s()"]+')
_WORDS = {"AND": "and", "OR": "or", "NOT": "not", "!": "not"}


def _plain(piece: str) -> str:
    return re.sub(r"\\(.)", r"\1", piece[1:-1]) if piece[:1] == '"' else piece


def _valued(name: str, piece: str, fields: Fields) -> Column:
    if name in fields.times:
        raise QueryError("times are given beside the query, not in it")
    if name == "_exists_":
        return exists(_plain(piece), fields)
    op = next((o for o in (">=", "<=", ">", "<") if piece.startswith(o)), "")
    return compared(name, op, piece[len(op) :], fields) if op else equal(name, _plain(piece), fields, piece[:1] != '"')


def compile_query(text: str, fields: Fields) -> Column:
    """The query as a Column for ``filter``; an empty one or ``*`` matches all rows."""
    if text.strip() in ("", "*"):
        return F.lit(True)
    if re.sub(_PIECES, "", text).strip():
        raise QueryError("a quotation mark is not closed")
    out: list[str | Column] = []
    group, depth, name = None, 0, None  # the field before a group of values, parentheses open in it, a field that waits for its value

    def add(piece: str | Column) -> None:
        opens = not isinstance(piece, str) or piece in ("(", "not")
        if opens and out and (not isinstance(out[-1], str) or out[-1] == ")"):
            out.append("and")  # side by side
        out.append(piece)

    for piece in _PIECES.findall(text):
        while piece.startswith("!") and len(piece) > 1 and name is None:
            add("not")
            piece = piece[1:]
        head, colon, rest = piece.partition(":") if piece[0] != '"' else (piece, "", "")
        if name is not None and piece == "(":
            group, depth, name = name, 0, None
            add("(")
        elif name is not None:
            if piece == ")" or piece in _WORDS:
                raise QueryError(f"{name}: has no value")
            add(_valued(name, piece, fields))
            name = None
        elif piece in ("(", ")") or piece in _WORDS:
            add(_WORDS.get(piece, piece))
            depth += {"(": 1, ")": -1}.get(piece, 0)
            if depth < 0:
                group, depth = None, 0
        elif group is not None:
            add(_valued(group, piece, fields))
        elif colon and re.fullmatch(r"[A-Za-z_@][\w.@-]*", head):
            if rest:
                add(_valued(head, rest, fields))
            else:
                name = head
        else:
            add(full_text(_plain(piece), fields.tokens))
    if name is not None:
        raise QueryError(f"{name}: has no value")
    try:
        return folded(out)
    except ValueError as e:
        raise QueryError(str(e)) from None
