"""The five aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PlanError, PlanTypeError
from ..types import LogicalType

AGGREGATES = ("count", "min", "max", "sum", "avg")


def result_type(op: str, kind: LogicalType, path: str) -> LogicalType:
    if op not in AGGREGATES:
        raise PlanError(f"unknown aggregate {op!r}", path)
    if op in ("sum", "avg") and not kind.numeric:
        raise PlanTypeError(f"{op} of a {kind.value} column", path)
    return LogicalType.INTEGER if op == "count" else LogicalType.REAL if op == "avg" else kind


def aggregate(op: str, column: Column) -> Column:
    """``count`` counts rows; min and max put NaN above all numbers; integer overflow is an error."""
    return {"count": F.count(F.lit(1)), "min": F.min(column), "max": F.max(column), "sum": F.sum(column), "avg": F.avg(column)}[op]
