"""The row filter language: ``column op value`` joined by AND.

Operators are = != < <= > >=; values are integers, floats, 'text' ('' is a quote), true, false and null. There is no OR, no parenthesis and
no comparison of columns. Equality is that of cells, so null matches null and a cell of another class never matches; ``!=`` is its
negation. Order holds only between numbers and between texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cells import class_of, written


class PredicateError(ValueError):
    pass


@dataclass(frozen=True)
class Clause:
    column: str
    op: str
    value: object  # None, bool, int, float or str


_NUMBER = re.compile(r"-?[0-9][0-9.eE-]*|-[0-9.eE-]*")


def _tokens(source: str) -> list[tuple[str, object]]:
    out, i = [], 0
    while i < len(source):
        c = source[i]
        if c.isspace():
            i += 1
        elif c in "=<>!":
            two = source[i : i + 2]
            if two in ("<=", ">=", "!="):
                out.append(("op", two))
                i += 2
            elif c == "!":
                raise PredicateError("unexpected character `!`")
            else:
                out.append(("op", c))
                i += 1
        elif c == "'":
            text, i = [], i + 1
            while True:
                end = source.find("'", i)
                if end < 0:
                    raise PredicateError("unterminated string")
                text.append(source[i:end])
                i = end + 1
                if source[i : i + 1] != "'":
                    break
                text.append("'")
                i += 1
            out.append(("value", "".join(text)))
        elif c in "0123456789-":
            word = _NUMBER.match(source, i)[0]
            out.append(("value", _number(word)))
            i += len(word)
        elif c.isalnum() or c == "_":
            end = i
            while end < len(source) and (source[end].isalnum() or source[end] in "_."):
                end += 1
            out.append(("name", source[i:end]))
            i = end
        else:
            raise PredicateError(f"unexpected character `{c}`")
    return out


def _number(word: str) -> int | float:
    if re.fullmatch(r"-?[0-9]+", word) and -(2**63) <= int(word) < 2**63:
        return int(word)
    try:
        return float(word)
    except ValueError:
        raise PredicateError(f"invalid number `{word}`") from None


_WORDS = {"true": True, "false": False, "null": None}


def parse(source: str) -> list[Clause]:
    tokens, out, i = _tokens(source), [], 0
    while True:
        column, op, value = (tokens[k] if k < len(tokens) else ("end", None) for k in (i, i + 1, i + 2))
        if column[0] != "name":
            raise PredicateError("expected a column name")
        if op[0] != "op":
            raise PredicateError("expected a comparison operator")
        if value[0] == "name" and value[1].lower() in _WORDS:
            out.append(Clause(column[1], op[1], _WORDS[value[1].lower()]))
        elif value[0] == "value":
            out.append(Clause(column[1], op[1], value[1]))
        else:
            raise PredicateError("expected a number, 'text', true, false or null")
        i += 3
        if i == len(tokens):
            return out
        if tokens[i][0] != "name" or str(tokens[i][1]).lower() != "and":
            raise PredicateError("expected AND")
        i += 1


def condition(clauses: list[Clause], columns: dict[str, tuple[Column, T.DataType]]) -> Column:
    """The conjunction as one boolean column; each clause stands alone, so Catalyst can push it to the scan."""
    return reduce(lambda a, b: a & b, [_clause(c, *columns[c.column]) for c in clauses])


def _clause(clause: Clause, c: Column, kind: T.DataType) -> Column:
    value, name = clause.value, class_of(kind)
    given = "null" if value is None else "bool" if isinstance(value, bool) else "int" if isinstance(value, int) else "float" if isinstance(value, float) else "text"
    numbers = {name, given} <= {"int", "float"}
    if clause.op in ("=", "!="):
        if value is None:
            hit = c.isNull()
        elif numbers:
            hit = (c if name == given else c.cast("double")).eqNullSafe(F.lit(value if name == given else float(value)))
        elif name == given:
            hit = (written(c, kind) if name == "text" else c).eqNullSafe(F.lit(value))
        else:
            hit = F.lit(False)
        return hit if clause.op == "=" else ~hit
    if numbers:
        left = c if name == given else c.cast("double")
        right = F.lit(value if name == given else float(value))
    elif name == given == "text":
        left, right = written(c, kind), F.lit(value)
    else:
        return F.lit(False)
    return {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[clause.op]
