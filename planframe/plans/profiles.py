"""How literally a plan is taken."""

from __future__ import annotations

from typing import Literal

from pyspark.sql import SparkSession

Profile = Literal["literal", "auto"]

#: What keeps the optimizer from changing the user's join order.
_LITERAL = {"spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.ReorderJoin", "spark.sql.cbo.enabled": "false"}


def session_for(spark: SparkSession, profile: Profile) -> SparkSession:
    """``literal`` plans live in a session of their own: settings are read when a frame is planned."""
    if profile == "auto":
        return spark
    if profile != "literal":
        raise ValueError(f"unknown profile {profile!r}")
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():  # all that the user has set
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key) and own.conf.get(key, None) != value:
            own.conf.set(key, value)
    for key, value in _LITERAL.items():
        rules = spark.conf.get(key, "") if key.endswith("excludedRules") else ""
        own.conf.set(key, ",".join(x for x in (rules, value) if x))
    return own
