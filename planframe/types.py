"""The four value types and how Spark columns take part in them."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class LogicalType(Enum):
    INTEGER = "INTEGER"
    REAL = "REAL"
    TEXT = "TEXT"
    BLOB = "BLOB"

    @property
    def spark(self) -> T.DataType:
        return _SPARK[self]

    @property
    def numeric(self) -> bool:
        return self in (LogicalType.INTEGER, LogicalType.REAL)

    def default(self) -> Column:
        """What a cell that can't be parsed becomes."""
        return F.lit(_DEFAULT[self]).cast(self.spark)


_SPARK = {
    LogicalType.INTEGER: T.LongType(),
    LogicalType.REAL: T.DoubleType(),
    LogicalType.TEXT: T.StringType(),
    LogicalType.BLOB: T.BinaryType(),
}
_DEFAULT = {LogicalType.INTEGER: 0, LogicalType.REAL: 0.0, LogicalType.TEXT: "", LogicalType.BLOB: b""}
#: Shorthand of a list of types, one letter each.
LETTERS = {"i": LogicalType.INTEGER, "r": LogicalType.REAL, "t": LogicalType.TEXT, "b": LogicalType.BLOB}


def from_spark(kind: T.DataType) -> LogicalType | None:
    """The type that a stored column takes, or None where there is none."""
    if isinstance(kind, T.IntegralType | T.TimestampType | T.TimestampNTZType):
        return LogicalType.INTEGER
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return LogicalType.REAL
    if isinstance(kind, T.StringType):
        return LogicalType.TEXT
    return LogicalType.BLOB if isinstance(kind, T.BinaryType) else None


def adapt(column: Column, kind: T.DataType) -> Column:
    """A stored column as a value of its type; timestamps are microseconds of UTC."""
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.unix_micros(column.cast("timestamp"))
    logical = from_spark(kind)
    return column if logical.spark == kind else column.cast(logical.spark)
