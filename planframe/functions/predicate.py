"""The predicate language: a small tree over column positions, from JSON or text.

Comparisons hold only between values of one type: columns of different types are neither
equal nor ordered, which is decided while planning. A literal must have its column's type.
NaN equals NaN and exceeds every number between columns, but against a literal it is
neither less, nor greater, nor equal.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PlanError, PlanTypeError
from ..types import LogicalType

LONG_MAX, LONG_MIN = (1 << 63) - 1, -(1 << 63)


@dataclass(frozen=True)
class And:
    left: Predicate
    right: Predicate


@dataclass(frozen=True)
class Or:
    left: Predicate
    right: Predicate


@dataclass(frozen=True)
class Not:
    child: Predicate


@dataclass(frozen=True)
class CompareLiteral:
    op: str
    col: int
    value: int | float


@dataclass(frozen=True)
class CompareColumns:
    op: str
    col: int
    other: int


@dataclass(frozen=True)
class Contains:
    col: int
    value: str


Predicate = And | Or | Not | CompareLiteral | CompareColumns | Contains
COMPARISONS = ("lt", "gt", "eq")


def parse(spec: Any, path: str = "$") -> Predicate:
    """From JSON: and, or, not with ``children``; lt, gt, eq with ``col`` and ``val`` or ``col2``; contains."""
    if not isinstance(spec, Mapping):
        raise PlanError("a predicate is an object", path)
    op = spec.get("op")
    if op in ("and", "or", "not"):
        children = spec.get("children")
        want = 1 if op == "not" else 2
        if not isinstance(children, Sequence) or len(children) != want:
            raise PlanError(f"{op} takes {want} children", path)
        parts = [parse(c, f"{path}.children[{i}]") for i, c in enumerate(children)]
        return Not(*parts) if op == "not" else And(*parts) if op == "and" else Or(*parts)
    if op in COMPARISONS:
        if "val" in spec:  # a literal goes before a second column
            value = spec["val"]
            if isinstance(value, bool) or not isinstance(value, int | float):
                raise PlanTypeError("only numbers can be compared with a column", path)
            if isinstance(value, int) and not LONG_MIN <= value <= LONG_MAX:
                raise PlanTypeError("integer out of range", path)
            return CompareLiteral(op, _index(spec, "col", path), value)
        return CompareColumns(op, _index(spec, "col", path), _index(spec, "col2", path))
    if op == "contains":
        if not isinstance(spec.get("val"), str):
            raise PlanTypeError("contains takes a string", path)
        return Contains(_index(spec, "col", path), spec["val"])
    raise PlanError(f"unknown predicate {op!r}", path)


def _index(spec: Mapping, key: str, path: str) -> int:
    i = spec.get(key)
    if isinstance(i, bool) or not isinstance(i, int) or i < 0:
        raise PlanError(f"{key} must be a column position", path)
    return i


def check(p: Predicate, types: Sequence[LogicalType], path: str = "$") -> None:
    """Positions in range, literals of their column's type, contains on text."""
    match p:
        case And(a, b) | Or(a, b):
            check(a, types, path)
            check(b, types, path)
        case Not(a):
            check(a, types, path)
        case _:
            for i in required_columns(p):
                if i >= len(types):
                    raise PlanError(f"column {i} of {len(types)}", path)
            kind = types[p.col]
            if isinstance(p, Contains) and kind is not LogicalType.TEXT:
                raise PlanTypeError("contains needs a TEXT column", path)
            if isinstance(p, CompareLiteral) and kind is not (LogicalType.INTEGER if isinstance(p.value, int) else LogicalType.REAL):
                raise PlanTypeError(f"a {kind.value} column can't be compared with {p.value!r}", path)


def required_columns(p: Predicate) -> frozenset[int]:
    match p:
        case And(a, b) | Or(a, b):
            return required_columns(a) | required_columns(b)
        case Not(a):
            return required_columns(a)
        case CompareColumns(_, a, b):
            return frozenset((a, b))
        case _:
            return frozenset((p.col,))


def lower(p: Predicate, columns: Sequence[Column], types: Sequence[LogicalType]) -> Column:
    match p:
        case And(a, b):
            return lower(a, columns, types) & lower(b, columns, types)
        case Or(a, b):
            return lower(a, columns, types) | lower(b, columns, types)
        case Not(a):
            return ~lower(a, columns, types)
        case Contains(i, value):
            return columns[i].contains(value)
        case CompareColumns(op, i, j):
            if types[i] is not types[j]:
                return F.lit(False)
            a, b = columns[i], columns[j]
            return a < b if op == "lt" else a > b if op == "gt" else a == b
        case CompareLiteral(op, i, value):
            c, v = columns[i], F.lit(value)
            if op == "lt":
                return c < v
            if op == "eq":
                return c == v
            # Spark puts NaN above all numbers; a literal is never exceeded by it here
            return (c > v) & ~F.isnan(c) if types[i] is LogicalType.REAL else c > v
    raise AssertionError(p)


# --- the text form: t1.0 = t2.1 and not (t1.3 > 8 or t2.1 contains "x") ---

_TOKEN = re.compile(r'\s*(?:(?P<number>\d+\.\d+|\d+(?!\w*\.))|(?P<column>[A-Za-z0-9]+\.\d+)|(?P<op><=|>=|!=|=|<|>)|(?P<string>"(?:\\.|[^"\\])*")|(?P<word>\w+)|(?P<paren>[()]))')
_OPS = {"=": "eq", "<": "lt", ">": "gt", "<=": "gt", ">=": "lt", "!=": "eq", "contains": "contains"}
_NEGATED = {"<=", ">=", "!="}


@dataclass(frozen=True)
class Term:
    """One comparison of the text form: ``left op right``; columns are (relation, position)."""

    op: str
    left: tuple[str, int]
    right: tuple[str, int] | int | float | str

    @property
    def columns(self) -> tuple[tuple[str, int], ...]:
        return (self.left, self.right) if isinstance(self.right, tuple) else (self.left,)


@dataclass(frozen=True)
class TextPredicate:
    """A parsed text predicate: ``tree`` of ("and" | "or", a, b), ("not", a) and terms."""

    tree: Any

    def required_columns(self) -> frozenset[tuple[str, int]]:
        return frozenset(c for t in self._terms(self.tree) for c in t.columns)

    def relations(self) -> frozenset[str]:
        return frozenset(r for r, _ in self.required_columns())

    def is_join_predicate_for(self, left: frozenset[str] | set[str], right: frozenset[str] | set[str]) -> bool:
        """Whether it needs both sides and nothing else."""
        own = self.relations()
        return bool(own & set(left)) and bool(own & set(right)) and own <= set(left) | set(right)

    def is_equijoin_predicate_for(self, left: frozenset[str] | set[str], right: frozenset[str] | set[str]) -> bool:
        t = self.tree
        return isinstance(t, Term) and t.op == "=" and isinstance(t.right, tuple) and self.is_join_predicate_for(left, right)

    def to_json(self, position) -> dict:
        """The JSON form; ``position`` maps (relation, column) to a position."""
        return self._json(self.tree, position)

    def _terms(self, t):
        if isinstance(t, Term):
            yield t
        else:
            for child in t[1:]:
                yield from self._terms(child)

    def _json(self, t, position) -> dict:
        if not isinstance(t, Term):
            return {"op": t[0], "children": [self._json(c, position) for c in t[1:]]}
        out: dict = {"op": _OPS[t.op], "col": position(*t.left)}
        if isinstance(t.right, tuple):
            out["col2"] = position(*t.right)
        else:
            out["val"] = t.right
        return {"op": "not", "children": [out]} if t.op in _NEGATED else out


def parse_text(text: str) -> TextPredicate:
    """``not`` binds tightest; ``and`` and ``or`` share one level and group to the left."""
    tokens, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise PlanError(f"can't read {text[at:]!r}", "predicate")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tokens.append(("end", ""))
    i = 0

    def take(kind: str, value: str | None = None) -> str:
        nonlocal i
        k, v = tokens[i]
        if k != kind or value is not None and v != value:
            raise PlanError(f"expected {value or kind}, found {v or 'the end'!r}", "predicate")
        i += 1
        return v

    def column(word: str) -> tuple[str, int]:
        relation, _, position = word.rpartition(".")
        return relation, int(position)

    def operand():
        nonlocal i
        if tokens[i] == ("word", "not"):
            i += 1
            return ("not", operand())
        if tokens[i] == ("paren", "("):
            i += 1
            inner = expression()
            take("paren", ")")
            return inner
        left = column(take("column"))
        if tokens[i] == ("word", "contains"):
            i += 1
            op = "contains"
        else:
            op = take("op")
        kind, value = tokens[i]
        i += 1
        if kind == "column":
            right = column(value)
        elif kind == "number":
            right = float(value) if "." in value else int(value)
        elif kind == "string":
            right = re.sub(r"\\(.)", r"\1", value[1:-1])
        else:
            raise PlanError(f"expected a column or literal, found {value or 'the end'!r}", "predicate")
        if (op == "contains") != isinstance(right, str):
            raise PlanTypeError("strings go with contains, and only they do", "predicate")
        return Term(op, left, right)

    def expression():
        nonlocal i
        tree = operand()
        while tokens[i] in (("word", "and"), ("word", "or")):
            word = tokens[i][1]
            i += 1
            tree = (word, tree, operand())
        return tree

    tree = expression()
    take("end")
    return TextPredicate(tree)
