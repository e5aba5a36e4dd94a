"""The three group-bys: a witness row, then one column per aggregate.

The witness is the first row of a group in the input's order. Each of its columns is an
aggregate of its own, so a projection above prunes the unused ones down to the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import aggregate, result_type
from ..types import LogicalType
from .relation import Placed, Relation, name, order_name

Aggregates = Sequence[tuple[str, int]]


def output_types(types: Sequence[LogicalType], aggregates: Aggregates, path: str = "$") -> tuple[LogicalType, ...]:
    return (*types, *[result_type(op, types[i], path) for op, i in aggregates])


def _columns(n: int, aggregates: Aggregates, place: Column | None, key: int | None) -> list[Column]:
    """``place`` is None where no witness column is used: any row's value will do then."""
    one = (lambda c: F.first(c)) if place is None else (lambda c: F.min_by(c, place))
    witness = [one(F.col(name(i))).alias(name(i)) for i in range(n) if i != key]
    return witness + [aggregate(op, F.col(name(i))).alias(name(n + k)) for k, (op, i) in enumerate(aggregates)]


def _place(rel: Relation) -> Column | None:
    return rel.place if rel.order else None


def _relation(df: DataFrame, types: tuple[LogicalType, ...], order: Column, sorted_by: Sequence[int] = ()) -> Relation:
    df = df.select(*[name(i) for i in range(len(types))], order.alias(order_name(0)))
    return Relation(df, types, (order_name(0),), tuple(sorted_by))


def hashed_group_by(rel: Relation, key: int, aggregates: Aggregates) -> Relation:
    """One row per key; partial aggregation before the shuffle, so a hot key is cheap."""
    types = output_types(rel.types, aggregates)
    df = rel.df.groupBy(name(key)).agg(*_columns(len(rel.types), aggregates, _place(rel), key))
    return _relation(df, types, F.col(name(key)))


def sorted_group_by(rel: Relation, key: int, aggregates: Aggregates) -> Relation:
    """One row per run of equal neighbouring keys: per key where the input is sorted by it."""
    types = output_types(rel.types, aggregates)
    if rel.sorted_by[:1] == (key,):
        df = rel.df.groupBy(name(key)).agg(*_columns(len(rel.types), aggregates, _place(rel), key))
        return _relation(df, types, F.col(name(key)), (key,))
    df = Placed.of(rel).runs(key).groupBy("__run").agg(*_columns(len(rel.types), aggregates, F.col("__m"), None))
    return _relation(df, types, F.col("__run"))


def all_rows_group_by(rel: Relation, aggregates: Aggregates) -> Relation:
    """One row for the whole input, none for an empty one."""
    types = output_types(rel.types, aggregates)
    df = rel.df.agg(*_columns(len(rel.types), aggregates, _place(rel), None), F.count(F.lit(1)).alias("__n")).where("__n > 0")
    return _relation(df, types, F.col("__n"))
