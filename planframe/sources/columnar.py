"""Columnar files: Parquet, compressed with Snappy. Only the columns asked for are read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import PlanError, PlanTypeError
from ..operators.relation import Relation, name, order_name
from ..types import LogicalType, adapt, from_spark


def table_types(spark: SparkSession, path: str) -> list[LogicalType | None]:
    """The type of each stored column, None for those that no type fits."""
    return [from_spark(f.dataType) for f in spark.read.parquet(path).schema.fields]


def read_columns(spark: SparkSession, path: str, cols: Sequence[int], types: Sequence[LogicalType | None] | None = None, at: str = "$", order: bool = True, known: dict[str, StructType] | None = None) -> Relation:
    """Columns of one file by position, in one scan; declared types are checked.

    ``order``: whether anything needs the rows' place in the file. ``known`` keeps the
    schemas of files, which takes a job to read.
    """
    known = {} if known is None else known
    raw = spark.read.schema(known[path]).parquet(path) if path in known else spark.read.parquet(path)
    fields = known.setdefault(path, raw.schema).fields
    found = []
    for k, i in enumerate(cols):
        if i >= len(fields):
            raise PlanError(f"column {i} of {len(fields)} in {path}", at)
        kind = from_spark(fields[i].dataType)
        if kind is None:
            raise PlanTypeError(f"column {i} of {path} is {fields[i].dataType.simpleString()}", at)
        if types and types[k] is not None and types[k] is not kind:
            raise PlanTypeError(f"column {i} of {path} is {kind.value}, not {types[k].value}", at)
        found.append(kind)
    df = raw.select(
        *[adapt(raw[fields[i].name], fields[i].dataType).alias(name(k)) for k, i in enumerate(cols)],
        *([F.col("_metadata.file_path").alias(order_name(0)), F.col("_metadata.row_index").alias(order_name(1))] if order else []),
    )
    return Relation(df, tuple(found), (order_name(0), order_name(1)) if order else ())


def read_columnar(spark: SparkSession, path: str, col: int, kind: LogicalType | None = None, at: str = "$", order: bool = True) -> Relation:
    return read_columns(spark, path, [col], [kind], at, order)


def write_columnar(rel: Relation, path: str, names: Sequence[str] | None = None) -> None:
    """Write in the relation's order; replaces what is there."""
    names = list(names) if names else [name(i) for i in range(len(rel.types))]
    df = rel.ordered().select(*[F.col(name(i)).alias(n) for i, n in enumerate(names)])
    df.write.mode("overwrite").parquet(path, compression="snappy")
