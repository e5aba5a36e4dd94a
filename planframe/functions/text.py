"""Strict parsing of text cells, and rendering of values as text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import LogicalType

# What counts as a number. Spark's own casts take more (blanks, suffixes, hex).
INTEGER_FORM = r"^[+-]?[0-9]+\z"
REAL_FORM = r"(?i)^[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)\z"


def parse_cell(cell: Column, kind: LogicalType) -> Column:
    """A cell as its declared type; what doesn't parse becomes the type's default."""
    if kind is LogicalType.TEXT:
        return F.coalesce(cell, kind.default())
    if kind is LogicalType.BLOB:
        return F.coalesce(cell.cast("binary"), kind.default())
    form = INTEGER_FORM if kind is LogicalType.INTEGER else REAL_FORM
    return F.coalesce(F.when(cell.rlike(form), cell.try_cast(kind.spark)), kind.default())


def render(column: Column, kind: LogicalType) -> Column:
    """A value as text: blobs in base64, reals without an exponent and without ``.0``."""
    if kind is LogicalType.TEXT:
        return column
    if kind is LogicalType.BLOB:
        return F.base64(column)
    if kind is LogicalType.INTEGER:
        return column.cast("string")
    text = column.cast("string")
    mantissa = F.regexp_extract(text, r"^-?([0-9]+)\.", 1)
    rest = F.regexp_replace(F.regexp_extract(text, r"\.([0-9]+)E", 1), "0+$", "")
    digits = F.concat(mantissa, rest)  # one digit before the point in this form
    power = F.regexp_extract(text, r"E(-?[0-9]+)$", 1).cast("int")
    whole = F.when(power + 1 >= F.length(digits), F.rpad(digits, power + 1, "0")).otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits))))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    plain = F.concat(F.when(text.startswith("-"), "-").otherwise(""), F.when(power >= 0, whole).otherwise(small))
    return (
        F.when(F.isnan(column), "NaN")
        .when(column == float("inf"), "inf")
        .when(column == float("-inf"), "-inf")
        .when(text.contains("E"), plain)
        .otherwise(F.regexp_replace(text, r"\.0$", ""))
    )


def rows_to_string(df: DataFrame, types: Sequence[LogicalType], sort: bool = False) -> Iterator[str]:
    """Each row as one line, cells rendered and a space between them; ``sort`` sorts the lines."""
    lines = df.select(F.concat_ws(" ", *[render(F.col(c), t) for c, t in zip(df.columns, types, strict=True)]).alias("line"))
    return (row["line"] for row in (lines.orderBy("line") if sort else lines).toLocalIterator())
