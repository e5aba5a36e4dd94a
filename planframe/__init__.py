"""planframe: explicit query plans, run as Spark DataFrames.

A plan is a tree of operators, written as JSON or with :class:`PlanBuilder`. Columns are
positional and have one of four types; values are never null and never coerced. The plan
is typed before anything runs, then lowered to one lazy DataFrame.
"""

from .builder import PlanBuilder
from .catalog import Catalog, plan_from_join_order
from .errors import InvalidChildrenError, OperatorFileError, PlanError, PlanTypeError, UnknownOperatorError
from .functions.text import rows_to_string
from .plans import OPERATORS, compile_plan, operator_metadata, to_dot
from .types import LogicalType

__all__ = [
    "OPERATORS",
    "Catalog",
    "InvalidChildrenError",
    "LogicalType",
    "OperatorFileError",
    "PlanBuilder",
    "PlanError",
    "PlanTypeError",
    "UnknownOperatorError",
    "compile_plan",
    "operator_metadata",
    "plan_from_join_order",
    "rows_to_string",
    "to_dot",
]
