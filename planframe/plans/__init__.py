"""Plans: the tree, its types, its lowering to Spark, and its picture."""

from .compiler import compile_plan
from .explain import to_dot
from .ir import OPERATORS, PlanNode, operator_metadata

__all__ = ["OPERATORS", "PlanNode", "compile_plan", "operator_metadata", "to_dot"]
