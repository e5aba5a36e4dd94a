"""Headline queries, timed: one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default all) choose
the data and cores. Each query runs once to warm up and then three times; its figure is
the least, and so is the part of it that builds the frame (compiling, reading schemas).
Results go to Spark's no-op sink, so every row is computed.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from planframe.queries import QUERIES

HEADLINE = [
    "bench_merge_join",
    "bench_merge_join_literal",
    "bench_sort_agg",
    "bench_hash_agg",
    "flagship",
    "join_chain_user_order",
    "hashed_group_by_witness",
    "loop_join_theta",
    "filter_and_or_not",
    "sort_multi",
    "zip_same_file",
]


def plain(spark: SparkSession, sf_dir: str) -> dict:
    """The benches written by hand, to compare with; like the plans, each finds out its files' schemas itself."""
    from pyspark.sql import functions as F

    def table(name: str):
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def agg():
        return table("lineitem").groupBy("l_linenumber").agg(F.min("l_partkey"), F.max("l_partkey"), F.count("*"))

    def join(hint: str | None = None):
        line, orders = table("lineitem"), table("orders").where("o_totalprice > 100000.0")
        line, orders = (line.hint(hint), orders.hint(hint)) if hint else (line, orders)
        return orders.join(line, orders.o_orderkey == line.l_orderkey).agg(F.count("*"))

    return {"plain_merge_join": join, "plain_merge_join_literal": lambda: join("merge"), "plain_sort_agg": agg, "plain_hash_agg": agg}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = {q: (lambda q=q: QUERIES[q](spark, sf_dir)) for q in HEADLINE} | plain(spark, sf_dir)
    seconds, building = {}, {}
    for name, make in runs.items():
        times = []
        for _ in range(4):
            began = time.perf_counter()
            df = make()
            built = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            times.append((time.perf_counter() - began, built - began))
        best = min(times[1:])
        seconds[name], building[name] = round(best[0], 4), round(best[1], 4)
    total = round(sum(seconds[q] for q in HEADLINE), 4)
    print(json.dumps({"metric": "headline queries, sum of best times", "value": total, "unit": "sec", "queries": seconds, "of it building the frame": building, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
