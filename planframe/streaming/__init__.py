"""Plans over micro-batches.

The plan language is one of finite inputs and has no stream operators. A stream of files
can still be fed through a plan batch by batch, with the sink of the caller's choice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relation import Relation, name, order_name
from ..types import adapt, from_spark


def each_batch(transform: Callable[[Relation], Relation], sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: the batch as a relation, through ``transform``, to ``sink``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        fields = batch.schema.fields
        types = tuple(from_spark(f.dataType) for f in fields)
        df = batch.select(*[adapt(F.col(f"`{f.name}`"), f.dataType).alias(name(i)) for i, f in enumerate(fields)], F.monotonically_increasing_id().alias(order_name(0)))
        sink(transform(Relation(df, types, (order_name(0),))).visible(), batch_id)

    return run
