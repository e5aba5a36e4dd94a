"""Typed CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import parse_cell, render
from ..operators.relation import Relation, name, order_name
from ..types import LogicalType


def read_csv(spark: SparkSession, path: str, types: Sequence[LogicalType], header: bool = True, multiline: bool = True, order: bool = True) -> Relation:
    """Skip the header, parse each cell strictly, put the type's default where that fails.

    Rows with too few or too many cells raise an error. ``multiline`` allows line ends in
    quoted cells, for which a file is one task; turn it off for large files without such
    cells, and each file is split. Rows are in the order of the file, where ``order`` is
    needed; files of a folder follow one another in no order that is promised.
    """
    schema = T.StructType([T.StructField(f"v{i}", T.StringType()) for i in range(len(types))])
    raw = spark.read.schema(schema).csv(path, header=header, multiLine=multiline, escape='"', mode="FAILFAST", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    df = raw.select(
        *[parse_cell(F.col(f"v{i}"), t).alias(name(i)) for i, t in enumerate(types)],
        *([F.monotonically_increasing_id().alias(order_name(0))] if order else []),
    )
    return Relation(df, tuple(types), (order_name(0),) if order else ())


def write_csv(rel: Relation, path: str, header: Sequence[str] | None = None, single_file: bool = False) -> None:
    """Quote where needed, ``\\n`` line ends, no header unless named; replaces what is there."""
    names = list(header) if header else [name(i) for i in range(len(rel.types))]
    df: DataFrame = rel.ordered().select(*[render(F.col(name(i)), t).alias(n) for i, (t, n) in enumerate(zip(rel.types, names, strict=True))])
    if single_file:
        df = df.coalesce(1)
    df.write.mode("overwrite").csv(path, header=bool(header), escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
