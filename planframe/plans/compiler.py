"""From a checked plan to a lazy DataFrame."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .. import sources
from ..errors import PlanError
from ..functions.predicate import required_columns
from ..operators import groupby, joins, rowwise
from ..operators.relation import Relation
from ..operators.sort import sort
from ..operators.zip import zip_relations
from .ir import PlanNode, read_plan
from .profiles import Profile, session_for


class CompiledPlan:
    """A typed plan; nothing has run yet."""

    def __init__(self, root: PlanNode):
        self.root = root

    def relation(self, spark: SparkSession, profile: Profile = "literal") -> Relation:
        if self.root.types is None:
            raise PlanError("a sink gives no rows")
        return _Lowering(session_for(spark, profile), profile == "literal").lower(self.root, True, _all(self.root))

    def to_dataframe(self, spark: SparkSession, profile: Profile = "literal", names: Sequence[str] | None = None) -> DataFrame:
        """The root's rows, lazily; sorted if the root's order comes from a sort.

        ``literal`` keeps the plan's join order and algorithms; ``auto`` leaves both to
        the optimizer. Both give the same rows.
        """
        if self.root.types is None:
            raise PlanError("a sink gives no rows")
        in_order = self._ends_sorted(self.root)
        rel = _Lowering(session_for(spark, profile), profile == "literal").lower(self.root, in_order, _all(self.root))
        return (rel.replaced(rel.ordered()) if in_order else rel).visible(names)

    def execute(self, spark: SparkSession, profile: Profile = "literal") -> None:
        """Run a plan whose root is a sink."""
        if self.root.types is not None:
            raise PlanError("the root isn't a sink")
        child = self.root.inputs[0]
        rel = _Lowering(session_for(spark, profile), profile == "literal").lower(child, True, _all(child))
        if self.root.op == "csv out":
            path, header, single = self.root.args
            sources.write_csv(rel, path, [f"c{i}" for i in range(len(rel.types))] if header else None, single)
        else:
            sources.write_columnar(rel, *self.root.args)

    def run(self, spark: SparkSession, profile: Profile = "literal") -> DataFrame | None:
        """Rows, or None after a sink has been written."""
        if self.root.types is None:
            return self.execute(spark, profile)
        return self.to_dataframe(spark, profile)

    @staticmethod
    def _ends_sorted(node: PlanNode) -> bool:
        while node.op in ("project", "filter"):
            node = node.inputs[0]
        return node.op == "sort"


def compile_plan(plan: str | bytes | Mapping[str, Any]) -> CompiledPlan:
    """Check and type a plan given as JSON text or as parsed JSON."""
    return CompiledPlan(read_plan(json.loads(plan) if isinstance(plan, str | bytes) else plan))


def _all(node: PlanNode) -> frozenset[int]:
    return frozenset(range(len(node.types)))


class _Lowering:
    """Each node is lowered with what is asked of it: whether the order of its rows matters, and which of its columns do."""

    def __init__(self, spark: SparkSession, literal: bool):
        self.spark, self.literal = spark, literal
        self.schemas: dict = {}

    def lower(self, node: PlanNode, order: bool, used: frozenset[int]) -> Relation:
        a = node.args
        match node.op:
            case "csv read":
                return sources.read_csv(self.spark, a[0], node.types, a[1], a[2], order)
            case "columnar read":
                return sources.read_columns(self.spark, a[0], [a[1]], node.types, node.path, order, self.schemas)
            case "project":
                return rowwise.project(self.lower(node.inputs[0], order, frozenset(a[0][i] for i in used)), a[0])
            case "filter":
                return rowwise.where(self.lower(node.inputs[0], order, used | required_columns(a[0])), a[0])
            case "loop join":
                return joins.loop_join(*self._sides(node, order, used | required_columns(a[0])), a[0], self.literal)
            case "merge join" | "hash join":
                width = len(node.inputs[0].types)
                make = joins.merge_join if node.op == "merge join" else joins.hash_join
                return make(*self._sides(node, order, used.union(a[0], (width + j for j in a[1]))), a[0], a[1], self.literal)
            case "sort":
                return sort(self.lower(node.inputs[0], order, used.union(a[0])), a[0])
            case "union":
                return self._zip(node, order, used)
            case "sorted group by":
                return groupby.sorted_group_by(self._grouped(node, a[0], a[1], used, self._has_runs(node)), *a)
            case "hashed group by":
                return groupby.hashed_group_by(self._grouped(node, a[0], a[1], used, False), *a)
            case "all rows group by":
                return groupby.all_rows_group_by(self._grouped(node, None, a[0], used, False), *a)
        raise PlanError(f"{node.op} can't be an input", node.path)

    def _sides(self, node: PlanNode, order: bool, used: frozenset[int]) -> list[Relation]:
        out, first = [], 0
        for child in node.inputs:
            width = len(child.types)
            out.append(self.lower(child, order, frozenset(i - first for i in used if first <= i < first + width)))
            first += width
        return out

    def _grouped(self, node: PlanNode, key: int | None, aggregates, used: frozenset[int], in_order: bool) -> Relation:
        """The input of a group-by: its order decides witness rows, if any of their columns are used."""
        child = node.inputs[0]
        witness = frozenset(i for i in used if i < len(child.types) and i != key)
        wanted = witness.union((i for _, i in aggregates), () if key is None else (key,))
        return self.lower(child, in_order or bool(witness), wanted)

    @staticmethod
    def _has_runs(node: PlanNode) -> bool:
        """Whether the input may be unsorted, so that neighbouring rows make the groups."""
        child = node.inputs[0]
        return not (child.op == "sort" and child.args[0][:1] == (node.args[0],))

    def _zip(self, node: PlanNode, order: bool, used: frozenset[int]) -> Relation:
        """One scan for columns of one file, one select for projections of one subtree."""
        base, picks = _origin(node)
        if isinstance(base, str):
            return sources.read_columns(self.spark, base, picks, node.types, node.path, order, self.schemas)
        if base is not node:
            return rowwise.project(self.lower(base, order, frozenset(picks[i] for i in used)), picks)
        return zip_relations(self._sides(node, order or len(node.inputs) > 1, used))


def _origin(node: PlanNode) -> tuple[str | PlanNode, list[int]]:
    """The file or subtree whose columns a node only picks, and which ones."""
    if node.op == "columnar read":
        return node.args[0], [node.args[1]]
    if node.op == "project":
        base, picks = _origin(node.inputs[0])
        return base, [picks[i] for i in node.args[0]]
    if node.op == "union":
        parts = [_origin(c) for c in node.inputs]
        first = parts[0][0]
        same = all(b == first if isinstance(first, str) or isinstance(b, str) else b.same_as(first) for b, _ in parts)
        if same:
            return first, [i for _, picks in parts for i in picks]
    return node, list(range(len(node.types)))
