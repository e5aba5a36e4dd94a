"""``python -m planframe [PLAN.json]``: run a plan and print its rows."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from .functions.text import rows_to_string
from .plans import compile_plan, operator_metadata, to_dot


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="planframe", description="Run a query plan.")
    parser.add_argument("plan", nargs="?", default="plan.json")
    parser.add_argument("--profile", choices=["literal", "auto"], default="literal")
    parser.add_argument("--dot", action="store_true", help="print the plan as a graph instead of running it")
    parser.add_argument("--sort", action="store_true", help="print the rows in the order of their text")
    parser.add_argument("--operators", action="store_true", help="print what there is to know about each operator, as JSON")
    args = parser.parse_args(argv)
    if args.operators:
        print(json.dumps(operator_metadata(), indent=2))
        return 0
    plan = compile_plan(Path(args.plan).read_text())
    if args.dot:
        print(to_dot(plan), end="")
        return 0
    spark = SparkSession.builder.appName("planframe").getOrCreate()
    df = plan.run(spark, args.profile)
    if df is None:
        print("The root operator returns no rows.")
        return 0
    for line in rows_to_string(df, plan.root.types, args.sort):
        print(line)
    return 0
