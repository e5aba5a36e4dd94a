"""The three inner joins; output columns are the left's, then the right's.

In literal mode hints fix the algorithm: nested loops, sort-merge, or a hash table built
from the left side. Otherwise the optimizer chooses.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicate as P
from .relation import Relation, name, order_name


def _sides(left: Relation, right: Relation) -> tuple[DataFrame, DataFrame]:
    """Both frames with columns numbered through and order columns set apart."""
    n = len(left.types)
    lo = [F.col(o).alias(f"__l{i}") for i, o in enumerate(left.order)]
    ro = [F.col(o).alias(f"__r{i}") for i, o in enumerate(right.order)]
    return left.df.select(*left.columns, *lo), right.df.select(*[c.alias(name(n + i)) for i, c in enumerate(right.columns)], *ro)


def _result(df: DataFrame, left: Relation, right: Relation, first: Sequence[Column], by_right: bool, sorted_by: Sequence[int] = ()) -> Relation:
    lo, ro = [F.col(f"__l{i}") for i in range(len(left.order))], [F.col(f"__r{i}") for i in range(len(right.order))]
    order = [*first, *(ro + lo if by_right else lo + ro)]
    types = left.types + right.types
    df = df.select(*[name(i) for i in range(len(types))], *[o.alias(order_name(i)) for i, o in enumerate(order)])
    return Relation(df, types, tuple(order_name(i) for i in range(len(order))), tuple(sorted_by))


def loop_join(left: Relation, right: Relation, predicate: P.Predicate, literal: bool = False) -> Relation:
    """Any predicate over the columns of both sides; rows in the order of the right, then the left."""
    a, b = _sides(left, right)
    types = left.types + right.types
    on = P.lower(predicate, [F.col(name(i)) for i in range(len(types))], types)
    a = a.hint("shuffle_replicate_nl") if literal else a
    return _result(a.join(b, on, "inner"), left, right, (), True)


def _equal(left: Relation, right: Relation, left_cols: Sequence[int], right_cols: Sequence[int]) -> Column | None:
    n = len(left.types)
    parts = [
        F.col(name(i)) == F.col(name(n + j)) if left.types[i] is right.types[j] else F.lit(False) for i, j in zip(left_cols, right_cols, strict=True)
    ]
    return reduce(lambda x, y: x & y, parts) if parts else None


def _equi(a: DataFrame, b: DataFrame, on: Column | None) -> DataFrame:
    return a.crossJoin(b) if on is None else a.join(b, on, "inner")


def merge_join(left: Relation, right: Relation, left_cols: Sequence[int], right_cols: Sequence[int], literal: bool = False) -> Relation:
    """Equal keys, sort-merge; rows in key order. The inputs need not be sorted."""
    a, b = _sides(left, right)
    if literal and left_cols:
        a, b = a.hint("merge"), b.hint("merge")
    df = _equi(a, b, _equal(left, right, left_cols, right_cols))
    return _result(df, left, right, [F.col(name(i)) for i in left_cols], False, left_cols)


def hash_join(left: Relation, right: Relation, left_cols: Sequence[int], right_cols: Sequence[int], literal: bool = False) -> Relation:
    """Equal keys, hash table on the left; keys of different types never match."""
    a, b = _sides(left, right)
    if literal and left_cols:
        a = a.hint("shuffle_hash")
    return _result(_equi(a, b, _equal(left, right, left_cols, right_cols)), left, right, (), True)
