"""Making relations from rows, and rows from relations."""

from __future__ import annotations

from pyspark.sql import types as T

from planframe.operators.relation import Relation, name, order_name
from planframe.types import LETTERS


def relation(spark, letters, rows):
    """Rows in list order, with columns of the types that ``letters`` name."""
    types = tuple(LETTERS[c] for c in letters)
    schema = T.StructType([T.StructField(name(i), t.spark) for i, t in enumerate(types)] + [T.StructField(order_name(0), T.LongType())])
    data = [(*r, i) for i, r in enumerate(rows)]
    return Relation(spark.createDataFrame(data, schema), types, (order_name(0),))


def rows(rel):
    """The rows in the relation's order."""
    return [tuple(r)[: len(rel.types)] for r in rel.df.orderBy(*rel.order).collect()]


def plain(value):
    return bytes(value) if isinstance(value, bytearray) else value
