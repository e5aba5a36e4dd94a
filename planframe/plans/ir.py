"""The plan tree: opcodes, arity, options and static types."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from ..errors import InvalidChildrenError, OperatorFileError, PlanError, PlanTypeError, UnknownOperatorError
from ..functions import predicate as P
from ..operators.groupby import output_types
from ..types import LETTERS, LogicalType


@dataclass(frozen=True)
class OperatorInfo:
    """``inputs``: how many, None for any number from one; what files it reads or writes."""

    inputs: int | None
    reads: bool = False
    writes: bool = False


#: The operators' names and arities.
OPERATORS: dict[str, OperatorInfo] = {
    "csv read": OperatorInfo(0, reads=True),
    "columnar read": OperatorInfo(0, reads=True),
    "csv out": OperatorInfo(1, writes=True),
    "columnar out": OperatorInfo(1, writes=True),
    "project": OperatorInfo(1),
    "filter": OperatorInfo(1),
    "loop join": OperatorInfo(2),
    "merge join": OperatorInfo(2),
    "hash join": OperatorInfo(2),
    "sort": OperatorInfo(1),
    "union": OperatorInfo(None),
    "sorted group by": OperatorInfo(1),
    "hashed group by": OperatorInfo(1),
    "all rows group by": OperatorInfo(1),
}


#: The operators' options.
OPTIONS: dict[str, tuple[str, ...]] = {
    "csv read": ("file", "types", "header", "multiline"),
    "columnar read": ("file", "col", "type"),
    "csv out": ("file", "header", "single_file"),
    "columnar out": ("file",),
    "project": ("cols",),
    "filter": ("predicate",),
    "loop join": ("predicate",),
    "merge join": ("left_cols", "right_cols"),
    "hash join": ("left_cols", "right_cols"),
    "sort": ("cols",),
    "union": (),
    "sorted group by": ("col", "aggregates"),
    "hashed group by": ("col", "aggregates"),
    "all rows group by": ("aggregates",),
}


def operator_metadata() -> dict[str, dict[str, Any]]:
    """What there is to know about each operator, as plain JSON values; ``inputs`` is null for any number from one."""
    return {op: {"inputs": i.inputs, "reads": i.reads, "writes": i.writes, "options": list(OPTIONS[op])} for op, i in OPERATORS.items()}


def check_inputs(op: str, got: int, path: str = "$") -> None:
    want = OPERATORS[op].inputs
    if got < 1 if want is None else got != want:
        raise InvalidChildrenError(op, "one or more" if want is None else str(want), got, path)


def check_file(op: str, has: bool, path: str = "$") -> None:
    uses = OPERATORS[op].reads or OPERATORS[op].writes
    if uses != has:
        raise OperatorFileError(op, uses, path)


@dataclass(frozen=True)
class PlanNode:
    """A checked operator. ``types`` is None for a sink. ``args`` holds what lowering needs."""

    id: int
    op: str
    options: Mapping[str, Any] = field(compare=False)
    inputs: tuple[PlanNode, ...]
    types: tuple[LogicalType, ...] | None
    args: tuple = ()
    path: str = field(default="$", compare=False)

    def walk(self):
        yield self
        for child in self.inputs:
            yield from child.walk()

    def same_as(self, other: PlanNode) -> bool:
        """Whether both subtrees are the same plan, whatever their numbers."""
        return (
            self.op == other.op
            and self.args == other.args
            and self.types == other.types
            and len(self.inputs) == len(other.inputs)
            and all(a.same_as(b) for a, b in zip(self.inputs, other.inputs, strict=True))
        )


def _type(code: Any, path: str) -> LogicalType:
    try:
        return LogicalType(code)
    except ValueError:
        raise PlanTypeError(f"unknown type {code!r}", path) from None


def _types(spec: Any, path: str) -> tuple[LogicalType, ...]:
    if isinstance(spec, str):
        if bad := [c for c in spec if c not in LETTERS]:
            raise PlanTypeError(f"unknown type letter {bad[0]!r}", path)
        return tuple(LETTERS[c] for c in spec)
    if not isinstance(spec, Sequence) or not spec:
        raise PlanError("types must list at least one type", path)
    return tuple(_type(c, path) for c in spec)


def _position(i: Any, n: int, path: str) -> int:
    if isinstance(i, bool) or not isinstance(i, int) or not 0 <= i < n:
        raise PlanError(f"{i!r} is not one of {n} column positions", path)
    return i


def _positions(spec: Any, n: int, path: str) -> tuple[int, ...]:
    if not isinstance(spec, Sequence) or isinstance(spec, str):
        raise PlanError("a list of column positions is needed", path)
    return tuple(_position(i, n, path) for i in spec)


class _Reader:
    def __init__(self):
        self.next_id = 0

    def read(self, spec: Any, path: str) -> PlanNode:
        if not isinstance(spec, Mapping):
            raise PlanError("an operator is an object", path)
        op, mine = spec.get("op"), self.next_id
        self.next_id += 1
        info = OPERATORS.get(op) if isinstance(op, str) else None
        if info is None:
            raise UnknownOperatorError(op, path)
        children, options = spec.get("input") or [], spec.get("options") or {}
        if not isinstance(children, Sequence) or not isinstance(options, Mapping):
            raise PlanError("input is a list and options an object", path)
        check_inputs(op, len(children), path)
        check_file(op, isinstance(options.get("file"), str), path)
        inputs = tuple(self.read(c, f"{path}.input[{i}]") for i, c in enumerate(children))
        if any(c.types is None for c in inputs):
            raise PlanError("a sink can't be an input", path)
        types, args = self._typed(op, options, [c.types for c in inputs], path)
        return PlanNode(mine, op, dict(options), inputs, types, args, path)

    @staticmethod
    def _need(options: Mapping, key: str, path: str) -> Any:
        if key not in options:
            raise PlanError(f"option {key!r} is missing", path)
        return options[key]

    def _typed(self, op: str, o: Mapping, ins: list[tuple[LogicalType, ...]], path: str) -> tuple[tuple[LogicalType, ...] | None, tuple]:
        """Output types and checked arguments."""
        at = f"{path}.options"
        need = lambda key: self._need(o, key, at)
        flat = tuple(t for side in ins for t in side)
        match op:
            case "csv read":
                types = _types(need("types"), at)
                return types, (o["file"], bool(o.get("header", True)), bool(o.get("multiline", True)))
            case "columnar read":
                col = need("col")
                if isinstance(col, bool) or not isinstance(col, int) or col < 0:
                    raise PlanError("col must be a column position", at)
                return (_type(need("type"), at),), (o["file"], col)
            case "csv out":
                return None, (o["file"], bool(o.get("header", False)), bool(o.get("single_file", False)))
            case "columnar out":
                return None, (o["file"],)
            case "project":
                cols = _positions(need("cols"), len(flat), at)
                return tuple(flat[i] for i in cols), (cols,)
            case "filter":
                p = P.parse(need("predicate"), f"{at}.predicate")
                P.check(p, flat, f"{at}.predicate")
                return flat, (p,)
            case "loop join":
                p = P.parse(need("predicate"), f"{at}.predicate")
                P.check(p, flat, f"{at}.predicate")
                return flat, (p,)
            case "merge join" | "hash join":
                left, right = _positions(need("left_cols"), len(ins[0]), at), _positions(need("right_cols"), len(ins[1]), at)
                if len(left) != len(right):
                    raise PlanError("left_cols and right_cols differ in length", at)
                if op == "merge join" and any(ins[0][i] is not ins[1][j] for i, j in zip(left, right, strict=True)):
                    raise PlanTypeError("merge keys must have one type", at)
                return flat, (left, right)
            case "sort":
                return flat, (_positions(need("cols"), len(flat), at),)
            case "union":
                return flat, ()
            case _:
                raw = need("aggregates")
                if not isinstance(raw, Sequence):
                    raise PlanError("aggregates is a list", at)
                aggregates = []
                for k, a in enumerate(raw):
                    here = f"{at}.aggregates[{k}]"
                    if not isinstance(a, Mapping) or not isinstance(a.get("op"), str):
                        raise PlanError("an aggregate has op and col", here)
                    aggregates.append((a["op"], _position(a.get("col"), len(flat), here)))
                key = () if op == "all rows group by" else (_position(need("col"), len(flat), at),)
                return output_types(flat, aggregates, at), (*key, tuple(aggregates))


def read_plan(spec: Any) -> PlanNode:
    """A checked tree from parsed JSON; nodes are numbered from the root, inputs in turn."""
    return _Reader().read(spec, "$")
