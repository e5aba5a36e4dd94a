import json

import pytest

from planframe import Catalog, PlanBuilder, compile_plan, operator_metadata, plan_from_join_order, rows_to_string, to_dot
from planframe.cli import main
from planframe.errors import InvalidChildrenError, OperatorFileError, PlanError, PlanTypeError, UnknownOperatorError

b = PlanBuilder()
CSV = {"op": "csv read", "options": {"file": "x.csv", "types": ["INTEGER", "TEXT", "REAL"]}}


def types(plan):
    t = compile_plan(plan).root.types
    return t and "".join(x.value[0] for x in t)


def node(op, options=None, *inputs):
    return {"op": op, "options": options or {}, "input": list(inputs)}


def test_output_types():
    assert types(CSV) == "ITR"
    assert types(node("project", {"cols": [2, 0, 0]}, CSV)) == "RII"
    assert types(node("sort", {"cols": [1]}, CSV)) == "ITR"
    assert types(node("union", {}, CSV, CSV)) == "ITRITR"
    assert types(node("hash join", {"left_cols": [0], "right_cols": [2]}, CSV, CSV)) == "ITRITR"
    assert types(node("columnar read", {"file": "f", "col": 3, "type": "BLOB"})) == "B"
    g = {"col": 1, "aggregates": [{"op": "count", "col": 1}, {"op": "avg", "col": 0}, {"op": "max", "col": 1}, {"op": "sum", "col": 0}]}
    assert types(node("hashed group by", g, CSV)) == types(node("sorted group by", g, CSV)) == "ITRIRTI"
    assert types(node("all rows group by", g, CSV)) == "ITRIRTI"
    assert types(node("csv out", {"file": "o"}, CSV)) is None


@pytest.mark.parametrize(
    "plan,error",
    [
        (node("scan"), UnknownOperatorError),
        ({"op": None}, UnknownOperatorError),
        ([], PlanError),
        (node("sort", {"cols": [0]}), InvalidChildrenError),
        (node("union"), InvalidChildrenError),
        (node("hash join", {"left_cols": [0], "right_cols": [0]}, CSV), InvalidChildrenError),
        (node("csv read", {"types": ["INTEGER"]}), OperatorFileError),
        (node("sort", {"cols": [0], "file": "x"}, CSV), OperatorFileError),
        (node("csv read", {"file": "x"}), PlanError),
        (node("csv read", {"file": "x", "types": ["DATE"]}), PlanTypeError),
        (node("project", {"cols": [3]}, CSV), PlanError),
        (node("project", {}, CSV), PlanError),
        (node("merge join", {"left_cols": [0], "right_cols": [2]}, CSV, CSV), PlanTypeError),
        (node("hash join", {"left_cols": [0], "right_cols": []}, CSV, CSV), PlanError),
        (node("filter", {"predicate": {"op": "lt", "col": 1, "val": 1}}, CSV), PlanTypeError),
        (node("hashed group by", {"col": 0, "aggregates": [{"op": "median", "col": 0}]}, CSV), PlanError),
        (node("hashed group by", {"col": 0, "aggregates": [{"op": "sum", "col": 1}]}, CSV), PlanTypeError),
        (node("hashed group by", {"col": 0, "aggregates": [{"op": "count", "col": 9}]}, CSV), PlanError),
        (node("sort", {"cols": [0]}, node("csv out", {"file": "o"}, CSV)), PlanError),
    ],
)
def test_bad_plans(plan, error):
    with pytest.raises(error):
        compile_plan(plan)


def test_errors_say_where():
    with pytest.raises(PlanError) as e:
        compile_plan(node("sort", {"cols": [0]}, node("project", {"cols": [8]}, CSV)))
    assert e.value.path == "$.input[0].options"


def test_builder():
    plan = b.project(b.hash_join(b.csv_read().file("a").types("iitir"), b.csv_read().file("b").types("it")).left_cols([0]).right_cols([0])).cols([0, 5])
    spec = plan.to_json()
    assert spec["op"] == "project" and spec["input"][0]["options"] == {"left_cols": [0], "right_cols": [0]}
    assert json.loads(plan.dumps()) == spec and plan.compile().root.types is not None
    with pytest.raises(UnknownOperatorError):
        _ = b.window
    with pytest.raises(InvalidChildrenError):
        b.sort()
    with pytest.raises(OperatorFileError):
        b.sort(plan).file("x")
    with pytest.raises(OperatorFileError):
        b.csv_read().to_json()
    with pytest.raises(PlanError):
        b.csv_read().having(clos=[1])
    with pytest.raises(PlanError):
        b.sort(plan).predicate({})
    with pytest.raises(AttributeError):
        b.sort(plan).clos([1])
    half = b.csv_read().file("a")
    assert half.types("i").to_json() != half.types("r").to_json() and "types" not in half.options


def test_operator_metadata():
    known = json.loads(json.dumps(operator_metadata()))
    assert len(known) == 14 and known["union"] == {"inputs": None, "reads": False, "writes": False, "options": []}
    assert known["csv read"]["reads"] and known["hash join"] == {"inputs": 2, "reads": False, "writes": False, "options": ["left_cols", "right_cols"]}


def test_dot():
    dot = to_dot(compile_plan(node("sort", {"cols": [0]}, CSV)))
    assert "sort" in dot and "(0)" in dot and "outputs INTEGER, TEXT, REAL" in dot and "n1 -> n0" in dot
    assert "x.csv" in dot and "types" not in dot


@pytest.fixture
def files(tmp_path):
    (tmp_path / "a.csv").write_text("h1,h2\n40,x\n-17,y\n55,z\n")
    (tmp_path / "b.csv").write_text("k,v,r\n" + "".join(f"{k},{i},{i / 2}\n" for i, k in enumerate([40, 1, -17, 40, 2])))
    return {"a": (str(tmp_path / "a.csv"), "it"), "b": (str(tmp_path / "b.csv"), "iir")}


def scans(files):
    return [b.csv_read().file(p).types(t) for p, t in files.values()]


@pytest.mark.parametrize("profile", ["literal", "auto"])
def test_joins_agree(spark, files, profile):
    plans = [
        b.loop_join(*scans(files)).predicate({"op": "eq", "col": 0, "col2": 2}),
        b.merge_join(*[b.sort(s).cols([0]) for s in scans(files)]).left_cols([0]).right_cols([0]),
        b.hash_join(*scans(files)).left_cols([0]).right_cols([0]),
    ]
    results = [sorted(map(tuple, p.compile().to_dataframe(spark, profile).collect())) for p in plans]
    assert results[0] == results[1] == results[2] and [r[0] for r in results[0]] == [-17, 40, 40]


@pytest.mark.parametrize("op,shape", [("loop_join", "CartesianProduct"), ("merge_join", "SortMergeJoin"), ("hash_join", "BuildLeft")])
def test_literal_plans_use_the_join_they_name(spark, files, op, shape):
    j = getattr(b, op)(*scans(files))
    j = j.predicate({"op": "eq", "col": 0, "col2": 2}) if op == "loop_join" else j.left_cols([0]).right_cols([0])
    plan = j.compile().to_dataframe(spark, "literal")._jdf.queryExecution().executedPlan().toString()
    assert shape in plan and (op != "hash_join" or "ShuffledHashJoin" in plan)


def test_literal_plans_keep_the_join_order(spark, files):
    a, c = scans(files)
    product = b.hash_join(a, scans(files)[0]).left_cols([]).right_cols([])
    plan = b.hash_join(product, c).left_cols([0]).right_cols([0]).compile().to_dataframe(spark, "literal")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in text.splitlines() if "Join" in line]
    assert len(joins) == 2 and "Cross" in joins[1] or "Inner" in joins[1]
    assert spark.conf.get("spark.sql.optimizer.excludedRules", "") == ""


def test_plan_as_text(spark, tmp_path):
    (tmp_path / "sales.csv").write_text("shop,price,item\n" + "".join(f"{i % 4},{i / 2},item {i}\n" for i in range(20)))
    cheap = node("filter", {"predicate": {"op": "lt", "col": 1, "val": 6.0}}, {"op": "csv read", "options": {"file": str(tmp_path / "sales.csv"), "types": ["INTEGER", "REAL", "TEXT"]}})
    per_shop = node("sorted group by", {"col": 0, "aggregates": [{"op": "sum", "col": 1}, {"op": "min", "col": 2}]}, node("sort", {"cols": [0]}, cheap))
    plan = json.dumps(node("project", {"cols": [4, 0, 3]}, per_shop))
    got = compile_plan(plan).run(spark).collect()
    assert sorted(map(tuple, got)) == [("item 0", 0, 6.0), ("item 1", 1, 7.5), ("item 10", 2, 9.0), ("item 11", 3, 10.5)]


def test_witness_rows_come_first_in_the_input(spark, tmp_path):
    """Also where only a witness column is asked for, above a sort, a filter and a join."""
    spark.range(60).selectExpr("id % 5 as k", "60 - id as v", "cast(id as string) as s").coalesce(1).write.parquet(str(tmp_path / "p"))
    read = b.union(*[b.columnar_read().file(str(tmp_path / "p")).col(i).type(t) for i, t in enumerate(["INTEGER", "INTEGER", "TEXT"])])
    first = b.project(b.hashed_group_by(b.filter(read).predicate({"op": "lt", "col": 1, "val": 50})).col(0).aggregates([{"op": "count", "col": 0}])).cols([0, 2])
    assert sorted(map(tuple, first.compile().to_dataframe(spark).collect())) == [(0, "15"), (1, "11"), (2, "12"), (3, "13"), (4, "14")]
    least = b.project(b.sorted_group_by(b.sort(read).cols([0, 1])).col(0).aggregates([{"op": "count", "col": 0}])).cols([2, 3])
    assert sorted(map(tuple, least.compile().to_dataframe(spark).collect())) == [(str(i), 12) for i in range(55, 60)]
    runs = b.project(b.sorted_group_by(read).col(0).aggregates([{"op": "count", "col": 0}])).cols([0, 3])
    assert runs.compile().to_dataframe(spark).count() == 60


def test_literal_plans_keep_the_settings_of_the_session(spark, files):
    from planframe.plans.profiles import session_for

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "12345")
    spark.conf.set("spark.sql.optimizer.excludedRules", "org.apache.spark.sql.catalyst.optimizer.CollapseWindow")
    try:
        own = session_for(spark, "literal")
        assert own.conf.get("spark.sql.autoBroadcastJoinThreshold") == "12345"
        rules = own.conf.get("spark.sql.optimizer.excludedRules")
        assert "CollapseWindow" in rules and "ReorderJoin" in rules
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.optimizer.excludedRules")


def test_zip_of_one_file_is_one_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 as d", "cast(id as string) as s").write.parquet(str(tmp_path / "p"))
    read = lambda i, t: b.columnar_read().file(str(tmp_path / "p")).col(i).type(t)
    z = b.union(read(0, "INTEGER"), b.project(read(1, "INTEGER")).cols([0]))
    plan = b.filter(z).predicate({"op": "gt", "col": 1, "val": 190}).compile().to_dataframe(spark)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "Join" not in text and "GreaterThan(d,190)" in text and "s:string" not in text
    assert plan.count() == 4


def test_zip_of_one_subtree_is_one_select(spark, files):
    a = scans(files)[0]
    z = b.union(b.project(a).cols([1]), b.project(a).cols([0]))
    df = z.compile().to_dataframe(spark)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in df.collect()] == [("x", 40), ("y", -17), ("z", 55)]


def test_unused_witness_columns_are_not_read(spark, tmp_path):
    spark.range(10).selectExpr("id % 2 as k", "id as v", "cast(id as string) as wide").write.parquet(str(tmp_path / "p"))
    read = [b.columnar_read().file(str(tmp_path / "p")).col(i).type(t) for i, t in enumerate(["INTEGER", "INTEGER", "TEXT"])]
    g = b.project(b.hashed_group_by(b.union(*read)).col(0).aggregates([{"op": "max", "col": 1}])).cols([0, 3])
    assert "wide" not in g.compile().to_dataframe(spark)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_join_order_plans(spark, files):
    c = Catalog()
    for name, (path, letters) in files.items():
        c.add(name, path, letters)
    with pytest.raises(ValueError):
        c.add("a", "x", "i")
    with pytest.raises(PlanError):
        c.add("z", "x", "i", "tape")
    c.add("p", "somewhere/p", "it")
    assert c.reader_for("p", [1]).to_json() == {"op": "union", "input": [{"op": "columnar read", "options": {"file": "somewhere/p", "col": 1, "type": "TEXT"}}]}
    plan = plan_from_join_order(c, ["b", "a"], ["a.0 = b.0", "b.1 > 0", 'a.1 contains "x" or b.2 < 1.5'], [("a", 1), ("b", 1)])
    spec = json.dumps(plan.to_json())
    assert '"hash join"' in spec and spec.count('"filter"') == 2
    assert sorted(map(tuple, plan.compile().to_dataframe(spark).collect())) == [("x", 3), ("y", 2)]
    loop = plan_from_join_order(c, ["a", "b"], ["a.0 > b.0"], [("a", 0), ("b", 0)])
    assert '"loop join"' in json.dumps(loop.to_json())
    assert len(plan_from_join_order(c, ["a", "b"], []).compile().to_dataframe(spark).collect()) == 15
    with pytest.raises(PlanError):
        plan_from_join_order(c, ["a"], ["b.0 = 1"])


def test_cli(spark, files, tmp_path, capsys):
    path = tmp_path / "plan.json"
    path.write_text(b.project(scans(files)[0]).cols([1, 0]).dumps())
    assert main([str(path)]) == 0
    assert capsys.readouterr().out == "x 40\ny -17\nz 55\n"
    assert main([str(path), "--sort"]) == 0 and capsys.readouterr().out == "x 40\ny -17\nz 55\n"
    assert main(["--operators"]) == 0 and '"csv read"' in capsys.readouterr().out
    plan = b.sort(scans(files)[0]).cols([0]).compile()
    assert list(rows_to_string(plan.to_dataframe(spark), plan.root.types)) == ["-17 y", "40 x", "55 z"]
    assert main([str(path), "--dot"]) == 0 and "digraph" in capsys.readouterr().out
    path.write_text(b.csv_out(scans(files)[0]).file(str(tmp_path / "o")).dumps())
    assert main([str(path)]) == 0 and "no rows" in capsys.readouterr().out


def test_stream_batches(spark):
    from planframe.operators.rowwise import project
    from planframe.streaming import each_batch

    got = []
    each_batch(lambda rel: project(rel, [1]), lambda df, i: got.append((i, [tuple(r) for r in df.collect()])))(spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string"), 4)
    assert got == [(4, [("a",), ("b",)])]
