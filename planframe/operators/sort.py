"""Sort: ascending, by several columns; ties stay in the input's order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from .relation import Relation, name


def sort(rel: Relation, cols: Sequence[int]) -> Relation:
    """The rows move only where the order is used or returned; see ``Relation.ordered``."""
    return rel.with_order(*[F.col(name(i)) for i in cols], *[F.col(o) for o in rel.order], sorted_by=cols)
