"""A plan as a Graphviz picture."""

from __future__ import annotations

import html
import json

from .compiler import CompiledPlan
from .ir import PlanNode


def _label(node: PlanNode) -> str:
    lines = [f"<b>{node.op}</b> ({node.id})"]
    lines += [f"{html.escape(k)}: {html.escape(json.dumps(v, sort_keys=True))}" for k, v in sorted(node.options.items()) if k != "types"]
    if node.types is not None:
        lines.append("outputs " + ", ".join(t.value for t in node.types))
    return "<br/>".join(lines)


def to_dot(plan: CompiledPlan | PlanNode) -> str:
    """One box per operator with its options and output types; edges run from input to user."""
    root = plan.root if isinstance(plan, CompiledPlan) else plan
    nodes = list(root.walk())
    boxes = [f"  n{n.id} [shape=box, label=<{_label(n)}>];" for n in nodes]
    edges = [f"  n{c.id} -> n{n.id};" for n in nodes for c in n.inputs]
    return "\n".join(["digraph plan {", "  rankdir=BT;", *boxes, *edges, "}"]) + "\n"
