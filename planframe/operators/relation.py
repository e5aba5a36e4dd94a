"""A relation: positional columns, their types, and how its rows are ordered.

Row order matters to few operators (zip, witness rows, runs). The compiler knows where it
does; only there do the columns that define it ride along hidden.
"""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..types import LogicalType


def name(i: int) -> str:
    return f"c{i}"


def order_name(i: int) -> str:
    return f"__o{i}"


@dataclass(frozen=True)
class Relation:
    """``df`` has columns c0.. and the ``order`` columns, which together are unique, or none where no order is needed.

    ``sorted_by`` lists the positions by which the rows are known to be sorted.
    """

    df: DataFrame
    types: tuple[LogicalType, ...]
    order: tuple[str, ...]
    sorted_by: tuple[int, ...] = ()

    @property
    def columns(self) -> list[Column]:
        return [F.col(name(i)) for i in range(len(self.types))]

    @property
    def place(self) -> Column:
        """One value that orders the rows."""
        return F.struct(*[F.col(o) for o in self.order])

    def visible(self, names: Sequence[str] | None = None) -> DataFrame:
        names = names or [name(i) for i in range(len(self.types))]
        return self.df.select(*[c.alias(n) for c, n in zip(self.columns, names, strict=True)])

    def ordered(self) -> DataFrame:
        """The rows globally sorted in their order where a sort defines it, else as they come."""
        return self.df.orderBy(*self.order) if self.sorted_by else self.df

    def with_order(self, *order: Column, sorted_by: Sequence[int] = ()) -> Relation:
        """Replace the order columns."""
        df = self.df.select(*self.columns, *[o.alias(order_name(i)) for i, o in enumerate(order)])
        return Relation(df, self.types, tuple(order_name(i) for i in range(len(order))), tuple(sorted_by))

    def replaced(self, df: DataFrame) -> Relation:
        return replace(self, df=df)


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the session's shared folder; on one machine, one of our own where none is set."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[[^-]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "planframe-checkpoints"))
    return df.checkpoint(eager=True)


@dataclass(frozen=True)
class Placed:
    """Rows sorted by their order and dealt into ranges: ``__p`` numbers the range, ``__m`` orders all rows.

    Checkpointed, so both numbers stay as they are. Whatever concerns neighbours across
    ranges is worked out on ``__p``, one row for each range.
    """

    df: DataFrame
    types: tuple[LogicalType, ...]

    @staticmethod
    def of(rel: Relation) -> Placed:
        ordered = rel.df.orderBy(*rel.order).select(*rel.columns, F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__m"))
        return Placed(shared_checkpoint(ordered), rel.types)

    def indexed(self) -> DataFrame:
        """``__i``: each row's position, from 0."""
        first = self.df.groupBy("__p").agg(F.count(F.lit(1)).alias("n"), F.min("__m").alias("first"))
        before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
        starts = first.select("__p", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
        # one row for each range of the sort
        return self.df.join(F.broadcast(starts), "__p").withColumn("__i", F.col("start") + F.col("__m") - F.col("first")).drop("first", "start", "__p", "__m")

    def runs(self, key: int) -> DataFrame:
        """``__run``: the number of the run of equal neighbouring keys that a row is in."""
        k = F.col(name(key))
        ends = self.df.groupBy("__p").agg(F.max_by(k, "__m").alias("last"))
        across = Window.orderBy("__p")
        ends = ends.select("__p", F.lag(F.struct("last")).over(across).alias("carried"))
        within = Window.partitionBy("__p").orderBy("__m")
        previous = F.coalesce(F.lag(F.struct(k.alias("last"))).over(within), F.col("carried"))
        starts = self.df.join(F.broadcast(ends), "__p").withColumn("__new", (previous.isNull() | ~previous["last"].eqNullSafe(k)).cast("long"))
        starts = shared_checkpoint(starts.withColumn("__nth", F.sum("__new").over(within)).drop("carried"))
        totals = starts.groupBy("__p").agg(F.sum("__new").alias("n"))
        before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select("__p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
        return starts.join(F.broadcast(totals), "__p").withColumn("__run", F.col("start") + F.col("__nth")).drop("start", "__nth", "__new", "__p")
