"""Every registered query of the plan engine against its SQL, at the smallest scale."""

import os
import re

import duckdb
import pytest

from planframe.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def cells(rows):
    return sorted(tuple(float(f"{x:.9g}") if isinstance(x, float) else x for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    expected = con.execute(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall()
    assert cells(map(tuple, df.select(*columns).collect())) == cells(expected)


def test_entry():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name,shape", [("hash_join_2key_literal", "ShuffledHashJoin"), ("merge_join_unsorted_literal", "SortMergeJoin"), ("bench_merge_join_literal", "SortMergeJoin"), ("loop_join_equi_literal", "CartesianProduct"), ("cross_join_empty_keys_literal", "CartesianProduct|BroadcastNestedLoopJoin"), ("flagship_literal", "ShuffledHashJoin")])
def test_literal_queries_use_the_joins_they_name(spark, name, shape):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert re.search(shape, plan) and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("name", ["bench_hash_agg", "bench_sort_agg", "bench_merge_join", "flagship"])
def test_scans_read_no_order_where_none_matters(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "row_index" not in plan and "file_path" not in plan


def test_two_key_join_of_whole_tables(spark):
    """Each line meets itself at least, whatever its number."""
    rows = QUERIES["hash_join_2key"](spark, DATA).select("l_orderkey", "l_linenumber").distinct().count()
    assert rows == spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct().count()
