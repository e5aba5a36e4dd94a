"""The registered queries: one or more for every operator, each with its SQL equivalent."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from .builder import PlanBuilder, Step
from .catalog import Catalog, plan_from_join_order
from .functions.predicate import parse_text

b = PlanBuilder()

#: Columns of the tables, in stored order: name and type letter.
TABLES: dict[str, str] = {
    "region": "r_regionkey:i r_name:t",
    "nation": "n_nationkey:i n_name:t n_regionkey:i",
    "customer": "c_custkey:i c_name:t c_nationkey:i c_acctbal:r c_mktsegment:t",
    "supplier": "s_suppkey:i s_name:t s_nationkey:i s_acctbal:r",
    "part": "p_partkey:i p_name:t p_brand:t p_type:t p_size:i p_retailprice:r",
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:t o_totalprice:r o_orderdate:i o_orderpriority:t",
    "lineitem": "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:r l_extendedprice:r l_discount:r l_tax:r l_returnflag:t l_linestatus:t l_shipdate:i",
    "events": "event_id:i ts:i user_id:i event_type:t value:r props:t",
}
_NAMES = {t: [c.partition(":")[0] for c in spec.split()] for t, spec in TABLES.items()}
_TYPES = {t: "".join(c.partition(":")[2] for c in spec.split()) for t, spec in TABLES.items()}
_CODES = {"i": "INTEGER", "r": "REAL", "t": "TEXT", "b": "BLOB"}


def scan(sf_dir: str, table: str, *columns: str) -> Step:
    """A zip of columnar reads, which becomes one scan of these columns."""
    names = _NAMES[table]
    picks = [names.index(c) for c in columns or names]
    return b.union(*[b.columnar_read().file(f"{sf_dir}/{table}.parquet").col(i).type(_CODES[_TYPES[table][i]]) for i in picks])


def lt(col: int, val: float | None = None, col2: int | None = None) -> dict:
    return _compare("lt", col, val, col2)


def gt(col: int, val: float | None = None, col2: int | None = None) -> dict:
    return _compare("gt", col, val, col2)


def eq(col: int, val: float | None = None, col2: int | None = None) -> dict:
    return _compare("eq", col, val, col2)


def _compare(op: str, col: int, val, col2) -> dict:
    return {"op": op, "col": col} | ({"val": val} if col2 is None else {"col2": col2})


def both(*p: dict) -> dict:
    return {"op": "and", "children": list(p)}


def either(*p: dict) -> dict:
    return {"op": "or", "children": list(p)}


def no(p: dict) -> dict:
    return {"op": "not", "children": [p]}


def agg(*specs: tuple[str, int]) -> list[dict]:
    return [{"op": op, "col": col} for op, col in specs]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
PLANS: dict[str, tuple[Callable[[str], Step], Sequence[str]]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None, names: Sequence[str], profile: str = "auto"):
    """Register ``make(sf_dir) -> Step`` under its name."""

    def put(make: Callable[[str], Step]):
        PLANS[make.__name__] = make, names
        _register(make.__name__, make, names, profile, sql)
        return make

    return put


def _register(key: str, make: Callable[[str], Step], names: Sequence[str], profile: str, sql: str | None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(sf_dir).compile().to_dataframe(spark, profile, names)

    QUERIES[key] = run
    if sql:
        ORACLE_SQL[key] = sql


# --- scans, projections, filters ---


@query("select c_custkey, c_nationkey::bigint as c_nationkey from customer", ["c_custkey", "c_nationkey"])
def scan_project(d):
    return b.project(scan(d, "customer")).cols([0, 2])


@query("select c_name as a, c_custkey as k, c_name as a2 from customer", ["a", "k", "a2"])
def project_reorder_dup(d):
    return b.project(scan(d, "customer", "c_custkey", "c_name")).cols([1, 0, 1])


_LINE = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"]
_LINE_SQL = "select l_orderkey, l_partkey, l_linenumber::bigint as l_linenumber, l_quantity from lineitem where "


def _lines(d):
    return scan(d, "lineitem", *_LINE)


@query(_LINE_SQL + "l_quantity < 10.0", _LINE)
def filter_lt_lit(d):
    return b.filter(_lines(d)).predicate(lt(3, 10.0))


@query(_LINE_SQL + "l_quantity > 45.0", _LINE)
def filter_gt_lit(d):
    return b.filter(_lines(d)).predicate(gt(3, 45.0))


@query(_LINE_SQL + "l_linenumber = 1", _LINE)
def filter_eq_lit(d):
    return b.filter(_lines(d)).predicate(eq(2, 1))


@query(_LINE_SQL + "l_orderkey < l_partkey", _LINE)
def filter_lt_col(d):
    return b.filter(_lines(d)).predicate(lt(0, col2=1))


@query(_LINE_SQL + "l_orderkey > l_partkey", _LINE)
def filter_gt_col(d):
    return b.filter(_lines(d)).predicate(gt(0, col2=1))


@query(_LINE_SQL + "l_linenumber = l_partkey", _LINE)
def filter_eq_col(d):
    return b.filter(_lines(d)).predicate(eq(2, col2=1))


@query("select p_partkey, p_name from part where contains(p_name, 'ring')", ["p_partkey", "p_name"])
def filter_contains(d):
    return b.filter(scan(d, "part", "p_partkey", "p_name")).predicate({"op": "contains", "col": 1, "val": "ring"})


@query(_LINE_SQL + "(l_quantity < 10.0 or l_quantity > 40.0) and not (l_linenumber = 2)", _LINE)
def filter_and_or_not(d):
    return b.filter(_lines(d)).predicate(both(either(lt(3, 10.0), gt(3, 40.0)), no(eq(2, 2))))


@query("select l_quantity, l_orderkey from lineitem where l_quantity > 30.0", ["l_quantity", "l_orderkey"])
def filter_after_project(d):
    return b.filter(b.project(_lines(d)).cols([3, 0])).predicate(gt(0, 30.0))


@query("select l_quantity, l_orderkey from lineitem where l_linenumber::bigint = 3 and l_quantity > 30.0", ["l_quantity", "l_orderkey"])
def project_after_filter(d):
    return b.project(b.filter(b.filter(_lines(d)).predicate(eq(2, 3))).predicate(gt(3, 30.0))).cols([3, 0])


@query(_LINE_SQL + "false", _LINE)
def filter_mixed_types(d):
    """An INTEGER never equals a REAL."""
    return b.filter(_lines(d)).predicate(eq(2, col2=3))


@query("select o_orderkey, o_totalprice from orders where (o_totalprice > 1000.0 and not (o_custkey <= 100)) or o_orderkey != 7 and o_custkey < 50", ["o_orderkey", "o_totalprice"])
def text_predicate(d):
    # and/or share one level, so the parentheses of the SQL above are spelled out
    p = parse_text("(o.2 > 1000.0 and not (o.1 <= 100)) or (o.0 != 7 and o.1 < 50)")
    return b.project(b.filter(scan(d, "orders", "o_orderkey", "o_custkey", "o_totalprice")).predicate(p.to_json(lambda _, i: i))).cols([0, 2])


# --- joins ---

_CO = "select c_custkey, c_name, o_orderkey, o_custkey, o_totalprice from customer join orders on c_custkey = o_custkey"
_CO_NAMES = ["c_custkey", "c_name", "o_orderkey", "o_custkey", "o_totalprice"]


def _co(d):
    return scan(d, "customer", "c_custkey", "c_name"), scan(d, "orders", "o_orderkey", "o_custkey", "o_totalprice")


@query(_CO, _CO_NAMES, "literal")
def hash_join_1key(d):
    return b.hash_join(*_co(d)).left_cols([0]).right_cols([1])


@query(
    "select l.l_orderkey, l.l_linenumber::bigint as l_linenumber, l.l_quantity, m.l_orderkey as o, m.l_suppkey as n, m.l_partkey as q from lineitem l join lineitem m on l.l_orderkey = m.l_orderkey and l.l_suppkey = m.l_suppkey",
    ["l_orderkey", "l_linenumber", "l_quantity", "o", "n", "q"],
)
def hash_join_2key(d):
    """Two whole tables."""
    left = scan(d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_suppkey")
    right = scan(d, "lineitem", "l_orderkey", "l_suppkey", "l_partkey")
    return b.project(b.hash_join(left, right).left_cols([0, 3]).right_cols([0, 1])).cols([0, 1, 2, 4, 5, 6])


@query("select c_custkey, s_acctbal from customer join supplier on false", ["c_custkey", "s_acctbal"])
def hash_join_mixed_types(d):
    """Keys of different types never match."""
    return b.hash_join(scan(d, "customer", "c_custkey"), scan(d, "supplier", "s_acctbal")).left_cols([0]).right_cols([0])


@query(_CO, _CO_NAMES, "literal")
def merge_join_1key(d):
    c, o = _co(d)
    return b.merge_join(b.sort(c).cols([0]), b.sort(o).cols([1])).left_cols([0]).right_cols([1])


@query(_CO, _CO_NAMES)
def merge_join_unsorted(d):
    return b.merge_join(*_co(d)).left_cols([0]).right_cols([1])


@query(
    "select n_nationkey::bigint as n_nationkey, n_name, r_regionkey::bigint as r_regionkey, r_name from nation join region on n_nationkey > r_regionkey",
    ["n_nationkey", "n_name", "r_regionkey", "r_name"],
    "literal",
)
def loop_join_theta(d):
    return b.loop_join(scan(d, "nation", "n_nationkey", "n_name"), scan(d, "region")).predicate(gt(0, col2=2))


@query(
    "select n_name, n_regionkey::bigint as n_regionkey, r_regionkey::bigint as r_regionkey, r_name from nation join region on n_regionkey = r_regionkey",
    ["n_name", "n_regionkey", "r_regionkey", "r_name"],
)
def loop_join_equi(d):
    return b.loop_join(scan(d, "nation", "n_name", "n_regionkey"), scan(d, "region")).predicate(eq(1, col2=2))


@query("select n_name, r_name from nation cross join region", ["n_name", "r_name"])
def cross_join_empty_keys(d):
    return b.hash_join(scan(d, "nation", "n_name"), scan(d, "region", "r_name")).left_cols([]).right_cols([])


@query(
    "select c_mktsegment, o_orderkey, l_linenumber::bigint as l_linenumber, l_quantity from customer join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey",
    ["c_mktsegment", "o_orderkey", "l_linenumber", "l_quantity"],
    "literal",
)
def join_chain_user_order(d):
    co = b.hash_join(scan(d, "customer", "c_custkey", "c_mktsegment"), scan(d, "orders", "o_orderkey", "o_custkey")).left_cols([0]).right_cols([1])
    col = b.hash_join(co, scan(d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")).left_cols([2]).right_cols([0])
    return b.project(col).cols([1, 2, 5, 6])


@query(
    "select n_name, s_suppkey, r_name from region join nation on r_regionkey = n_regionkey join supplier on s_nationkey = n_nationkey where s_acctbal > 0.0 and s_suppkey >= n_regionkey",
    ["n_name", "s_suppkey", "r_name"],
)
def plan_by_join_order(d):
    c = Catalog()
    for t in ("region", "nation", "supplier"):
        c.add(t, f"{d}/{t}.parquet", _TYPES[t])
    predicates = ["region.0 = nation.2", "supplier.2 = nation.0", "supplier.3 > 0.0", "supplier.0 >= nation.2"]
    return plan_from_join_order(c, ["region", "nation", "supplier"], predicates, [("nation", 1), ("supplier", 0), ("region", 1)])


# --- sort and group-bys ---


@query("select c_name, c_nationkey::bigint as c_nationkey, c_custkey from customer", ["c_name", "c_nationkey", "c_custkey"])
def sort_multi(d):
    return b.sort(scan(d, "customer", "c_name", "c_nationkey", "c_custkey")).cols([1, 0])


@query("select c_nationkey::bigint as k, count(*) as n, min(c_acctbal) as lo, max(c_acctbal) as hi from customer group by 1", ["k", "n", "lo", "hi"])
def hashed_group_by(d):
    g = b.hashed_group_by(scan(d, "customer", "c_nationkey", "c_acctbal")).col(0).aggregates(agg(("count", 0), ("min", 1), ("max", 1)))
    return b.project(g).cols([0, 2, 3, 4])


@query(
    "select c_custkey, c_name, c_nationkey::bigint as c_nationkey, n, lo from (select *, row_number() over (partition by c_nationkey order by c_custkey) as r, count(*) over (partition by c_nationkey) as n, min(c_acctbal) over (partition by c_nationkey) as lo from customer) where r = 1",
    ["c_custkey", "c_name", "c_nationkey", "n", "lo"],
)
def hashed_group_by_witness(d):
    g = b.hashed_group_by(b.sort(scan(d, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal")).cols([0])).col(2).aggregates(agg(("count", 0), ("min", 3)))
    return b.project(g).cols([0, 1, 2, 4, 5])


@query("select l_suppkey as k, count(*) as n, sum(l_quantity) as q, max(l_shipdate_us) as last from (select *, epoch_us(l_shipdate) as l_shipdate_us from lineitem) group by 1", ["k", "n", "q", "last"])
def sorted_group_by(d):
    g = b.sorted_group_by(b.sort(scan(d, "lineitem", "l_suppkey", "l_quantity", "l_shipdate")).cols([0])).col(0).aggregates(agg(("count", 0), ("sum", 1), ("max", 2)))
    return b.project(g).cols([0, 3, 4, 5])


@query(
    "select min(c_custkey) as first_key, any_value(c_nationkey)::bigint as k, count(*) as n from (select c_custkey, c_nationkey, sum(new) over (order by c_custkey) as run from (select c_custkey, c_nationkey, case when lag(c_nationkey) over (order by c_custkey) is distinct from c_nationkey then 1 else 0 end as new from customer)) group by run",
    ["first_key", "k", "n"],
)
def sorted_group_by_runs(d):
    """Sorted by another column: one row for each run of equal neighbours."""
    g = b.sorted_group_by(b.sort(scan(d, "customer", "c_custkey", "c_nationkey")).cols([0])).col(1).aggregates(agg(("count", 0)))
    return b.project(g).cols([0, 1, 2])


@query("select count(*) as n, min(o_totalprice) as lo, max(o_totalprice) as hi from orders", ["n", "lo", "hi"])
def all_rows_group_by(d):
    return b.project(b.all_rows_group_by(scan(d, "orders", "o_totalprice")).aggregates(agg(("count", 0), ("min", 0), ("max", 0)))).cols([1, 2, 3])


@query("select count(*) as n, max(o_totalprice) as hi from orders where o_totalprice < -1e9 having count(*) > 0", ["n", "hi"])
def all_rows_group_by_empty(d):
    return b.project(b.all_rows_group_by(b.filter(scan(d, "orders", "o_totalprice")).predicate(lt(0, -1e9))).aggregates(agg(("count", 0), ("max", 0)))).cols([1, 2])


def _by_flag(d, op, column):
    g = b.hashed_group_by(scan(d, "lineitem", "l_returnflag", column)).col(0).aggregates(agg((op, 1)))
    return b.project(g).cols([0, 2])


@query("select l_returnflag as k, sum(l_linenumber)::bigint as v from lineitem group by 1", ["k", "v"])
def agg_sum_int(d):
    return _by_flag(d, "sum", "l_linenumber")


@query("select l_returnflag as k, sum(l_quantity) as v from lineitem group by 1", ["k", "v"])
def agg_sum_real(d):
    return _by_flag(d, "sum", "l_quantity")


@query("select l_returnflag as k, avg(l_quantity) as v from lineitem group by 1", ["k", "v"])
def agg_avg(d):
    return _by_flag(d, "avg", "l_quantity")


@query("select l_returnflag as k, min(l_linestatus) as v from lineitem group by 1", ["k", "v"])
def agg_min_text(d):
    return _by_flag(d, "min", "l_linestatus")


@query("select l_returnflag as k, max(l_linestatus) as v from lineitem group by 1", ["k", "v"])
def agg_max_text(d):
    return _by_flag(d, "max", "l_linestatus")


@query("select l_returnflag as k, count(*) as v from lineitem group by 1", ["k", "v"])
def agg_count(d):
    return _by_flag(d, "count", "l_linestatus")


@query("select l_orderkey as k, count(*) as n from lineitem group by 1 having count(*) > 6", ["k", "n"])
def having_filter(d):
    g = b.project(b.hashed_group_by(scan(d, "lineitem", "l_orderkey")).col(0).aggregates(agg(("count", 0)))).cols([0, 1])
    return b.filter(g).predicate(gt(1, 6))


# --- zip ---


@query("select s_suppkey, s_name, s_acctbal from supplier", ["s_suppkey", "s_name", "s_acctbal"])
def zip_same_file(d):
    return scan(d, "supplier", "s_suppkey", "s_name", "s_acctbal")


@query(
    "select n_name, r_name from (select n_name, row_number() over (order by n_nationkey) as i from nation) join (select r_name, row_number() over (order by r_regionkey desc) as j, row_number() over (order by r_regionkey) as i from region) using (i)",
    ["n_name", "r_name"],
)
def zip_two_tables(d):
    n = b.project(b.sort(scan(d, "nation", "n_nationkey", "n_name")).cols([0])).cols([1])
    r = b.project(b.sort(scan(d, "region")).cols([0])).cols([1])
    return b.union(n, r)


@query(
    "select o_orderkey, o_totalprice, c_custkey from (select o_orderkey, o_totalprice, row_number() over (order by o_totalprice, o_orderkey) as i from orders) join (select c_custkey, row_number() over (order by c_acctbal, c_custkey) as i from customer) using (i)",
    ["o_orderkey", "o_totalprice", "c_custkey"],
)
def zip_uneven(d):
    o = b.sort(scan(d, "orders", "o_orderkey", "o_totalprice")).cols([1, 0])
    c = b.project(b.sort(scan(d, "customer", "c_custkey", "c_acctbal")).cols([1, 0])).cols([0])
    return b.union(o, c)


# --- sinks ---


def _scratch(spark: SparkSession) -> str:
    """A new folder that all executors see: under the shared checkpoint folder where one is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "planframe-scratch")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark) + ".csv"
    b.csv_out(scan(sf_dir, "customer", "c_custkey", "c_name", "c_acctbal")).file(path).header(True).compile().execute(spark, "auto")
    return b.csv_read().file(path).types("itr").compile().to_dataframe(spark, "auto", ["c_custkey", "c_name", "c_acctbal"])


def columnar_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark)
    b.columnar_out(b.sort(scan(sf_dir, "part", "p_partkey", "p_name", "p_size")).cols([2, 0])).file(path).compile().execute(spark, "auto")
    back = b.union(*[b.columnar_read().file(path).col(i).type(t) for i, t in enumerate(["INTEGER", "TEXT", "INTEGER"])])
    return back.compile().to_dataframe(spark, "auto", ["p_partkey", "p_name", "p_size"])


QUERIES |= {"csv_roundtrip": csv_roundtrip, "columnar_roundtrip": columnar_roundtrip}
ORACLE_SQL |= {
    "csv_roundtrip": "select c_custkey, c_name, c_acctbal from customer",
    "columnar_roundtrip": "select p_partkey, p_name, p_size::bigint as p_size from part",
}


# --- whole plans ---


@query(
    "select c_mktsegment, count(*) as n, min(l_quantity) as lo, max(l_quantity) as hi, sum(l_quantity) as q from customer join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey where l_quantity > 25.0 group by 1",
    ["c_mktsegment", "n", "lo", "hi", "q"],
)
def flagship(d):
    """Three tables joined by hash, filtered, grouped."""
    lines = b.filter(scan(d, "lineitem", "l_orderkey", "l_quantity")).predicate(gt(1, 25.0))
    co = b.hash_join(scan(d, "customer", "c_custkey", "c_mktsegment"), scan(d, "orders", "o_orderkey", "o_custkey")).left_cols([0]).right_cols([1])
    col = b.hash_join(co, lines).left_cols([2]).right_cols([0])
    g = b.hashed_group_by(col).col(1).aggregates(agg(("count", 0), ("min", 5), ("max", 5), ("sum", 5)))
    return b.project(g).cols([1, 6, 7, 8, 9])


@query("select count(*) as n from orders join lineitem on o_orderkey = l_orderkey where o_custkey = 7 or o_totalprice > 300000.0", ["n"])
def keywords_shape(d):
    o = b.filter(scan(d, "orders", "o_orderkey", "o_custkey", "o_totalprice")).predicate(either(eq(1, 7), gt(2, 300000.0)))
    m = b.merge_join(o, scan(d, "lineitem", "l_orderkey")).left_cols([0]).right_cols([0])
    return b.project(b.all_rows_group_by(m).aggregates(agg(("count", 0)))).cols([4])


@query("select count(*) as n from orders join lineitem on o_orderkey = l_orderkey where o_totalprice > 100000.0", ["n"])
def bench_merge_join(d):
    o = b.filter(scan(d, "orders", "o_orderkey", "o_totalprice")).predicate(gt(1, 100000.0))
    m = b.merge_join(o, scan(d, "lineitem", "l_orderkey")).left_cols([0]).right_cols([0])
    return b.project(b.all_rows_group_by(m).aggregates(agg(("count", 0)))).cols([3])


def _bench_agg(source, group):
    g = group(source).col(0).aggregates(agg(("min", 1), ("max", 1), ("count", 1)))
    return b.project(g).cols([0, 3, 4, 5])


_BENCH_SQL = "select l_linenumber::bigint as k, min(l_partkey) as lo, max(l_partkey) as hi, count(*) as n from lineitem group by 1"


@query(_BENCH_SQL, ["k", "lo", "hi", "n"])
def bench_sort_agg(d):
    return _bench_agg(b.sort(scan(d, "lineitem", "l_linenumber", "l_partkey", "l_quantity")).cols([0]), b.sorted_group_by)


@query(_BENCH_SQL, ["k", "lo", "hi", "n"])
def bench_hash_agg(d):
    return _bench_agg(scan(d, "lineitem", "l_linenumber", "l_partkey", "l_quantity"), b.hashed_group_by)


# --- the same plans with the joins that they name ---

for _name in ("hash_join_2key", "hash_join_mixed_types", "cross_join_empty_keys", "merge_join_unsorted", "loop_join_equi", "plan_by_join_order", "keywords_shape", "bench_merge_join", "flagship"):
    _register(f"{_name}_literal", *PLANS[_name], "literal", ORACLE_SQL[_name])
