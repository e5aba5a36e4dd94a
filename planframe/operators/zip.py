"""Positional zip: row i of each input side by side, as long as the shortest.

Plans that zip columns of one file, or projections of one subtree, never get here: they
become one select (see the compiler). What is left are inputs of different origin, whose
rows are numbered range by range and joined on the number.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import functions as F

from .relation import Placed, Relation, name, order_name


def zip_relations(rels: Sequence[Relation]) -> Relation:
    if len(rels) == 1:
        return rels[0]
    frames, types = [], []
    for r in rels:
        df = Placed.of(r).indexed()
        frames.append(df.select("__i", *[F.col(name(i)).alias(name(len(types) + i)) for i in range(len(r.types))]))
        types += r.types
    df = reduce(lambda a, b: a.join(b, "__i"), frames)
    return Relation(df.select(*[name(i) for i in range(len(types))], F.col("__i").alias(order_name(0))), tuple(types), (order_name(0),))
