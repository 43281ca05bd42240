"""Boolean texts over named parts, folded to one Column.

A text is turned into a Python expression of placeholders, ``and``, ``or``, ``not`` and parentheses; Python's own parser reads that, and
the tree is folded over the parts' Columns.  So there is no grammar of our own here, for searches or for rule conditions.
"""

from __future__ import annotations

import ast
from functools import reduce

from pyspark.sql import Column


def folded(pieces: list[str | Column]) -> Column:
    """The Column of pieces, each a Column, ``(``, ``)``, ``and``, ``or`` or ``not``.  A ValueError tells what is wrong with their order."""
    names = [p if isinstance(p, str) else f"c{i}" for i, p in enumerate(pieces)]
    try:
        tree = ast.parse(" ".join(names) or "()", mode="eval").body
    except (SyntaxError, RecursionError, MemoryError) as e:
        raise ValueError(f"operators or parentheses are out of place: {e.args[0]}") from None

    def column(node: ast.expr) -> Column:
        if isinstance(node, ast.Name):
            return pieces[int(node.id[1:])]
        if isinstance(node, ast.BoolOp):
            return reduce((lambda a, b: a & b) if isinstance(node.op, ast.And) else (lambda a, b: a | b), map(column, node.values))
        if isinstance(node, ast.UnaryOp):
            return ~column(node.operand)
        raise ValueError("a term is missing, or an operator between two")

    return column(tree)
