"""Project and filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from ..functions import predicate as P
from .relation import Relation, name


def project(rel: Relation, cols: Sequence[int]) -> Relation:
    """Select, reorder or repeat columns by position."""
    df = rel.df.select(*[F.col(name(i)).alias(name(k)) for k, i in enumerate(cols)], *rel.order)
    known = []
    for i in rel.sorted_by:
        if i not in cols:
            break
        known.append(cols.index(i))
    return Relation(df, tuple(rel.types[i] for i in cols), rel.order, tuple(known))


def where(rel: Relation, predicate: P.Predicate) -> Relation:
    return rel.replaced(rel.df.where(P.lower(predicate, rel.columns, rel.types)))
