import math

import pytest
from helpers import relation, rows

from planframe.errors import PlanError, PlanTypeError
from planframe.functions import predicate as P
from planframe.functions.predicate import parse_text
from planframe.operators.rowwise import where
from planframe.types import LogicalType

NAN = float("nan")
I, R, X, B = LogicalType.INTEGER, LogicalType.REAL, LogicalType.TEXT, LogicalType.BLOB


def keep(spark, letters, data, spec):
    p = P.parse(spec)
    rel = relation(spark, letters, data)
    P.check(p, rel.types)
    return rows(where(rel, p))


def test_and_or_not(spark):
    data = [("red", 10), ("red", 30), ("blue", 10), ("blue", 30)]
    red, many = {"op": "contains", "col": 0, "val": "red"}, {"op": "gt", "col": 1, "val": 20}
    assert keep(spark, "ti", data, {"op": "and", "children": [red, many]}) == [("red", 30)]
    assert keep(spark, "ti", data, {"op": "or", "children": [red, many]}) == [("red", 10), ("red", 30), ("blue", 30)]
    assert keep(spark, "ti", data, {"op": "not", "children": [red]}) == data[2:]


@pytest.mark.parametrize("op,expected", [("lt", [(1, 2)]), ("gt", [(3, 2)]), ("eq", [(2, 2)])])
def test_columns(spark, op, expected):
    assert keep(spark, "ii", [(1, 2), (2, 2), (3, 2)], {"op": op, "col": 0, "col2": 1}) == expected


def test_text_and_blob_columns_compare_bytewise(spark):
    assert keep(spark, "tt", [("a", "b"), ("é", "z")], {"op": "lt", "col": 0, "col2": 1}) == [("a", "b")]
    data = [(b"\x80", b"\x01\x02"), (b"\x01", b"\x01\x02")]
    assert len(keep(spark, "bb", data, {"op": "gt", "col": 0, "col2": 1})) == 1


def test_contains(spark):
    data = [("a test b",), ("a%b",), ("",)]
    assert keep(spark, "t", data, {"op": "contains", "col": 0, "val": "test"}) == data[:1]
    assert keep(spark, "t", data, {"op": "contains", "col": 0, "val": "%"}) == data[1:2]
    assert keep(spark, "t", data, {"op": "contains", "col": 0, "val": ""}) == data


def test_nan(spark):
    data = [(NAN, 1.0), (2.0, NAN), (NAN, NAN), (-0.0, 0.0)]
    gt = {"op": "gt", "col": 0, "val": 1.0}
    assert keep(spark, "rr", data, gt)[0][0] == 2.0 and len(keep(spark, "rr", data, gt)) == 1
    assert len(keep(spark, "rr", data, {"op": "not", "children": [gt]})) == 3
    assert len(keep(spark, "rr", data, {"op": "eq", "col": 0, "col2": 1})) == 2  # NaN = NaN, -0 = 0
    assert math.isnan(keep(spark, "rr", data, {"op": "gt", "col": 0, "col2": 1})[0][0])


def test_types_never_mix(spark):
    for op in ("lt", "gt", "eq"):
        assert keep(spark, "ir", [(1, 1.0), (1, 2.0), (2, 1.0)], {"op": op, "col": 0, "col2": 1}) == []


@pytest.mark.parametrize(
    "spec",
    [
        {"op": "lt", "col": 0, "val": 1.0},
        {"op": "lt", "col": 1, "val": 1},
        {"op": "eq", "col": 2, "val": 1},
        {"op": "contains", "col": 0, "val": "x"},
    ],
)
def test_literal_of_another_type(spec):
    with pytest.raises(PlanTypeError):
        P.check(P.parse(spec), (I, R, X))


@pytest.mark.parametrize(
    "spec",
    [
        {"op": "lte", "col": 0, "val": 1},
        {"op": "eq", "col": 0, "val": "text"},
        {"op": "eq", "col": 0, "val": True},
        {"op": "eq", "col": 0, "val": 1 << 63},
        {"op": "eq", "col": -1, "val": 1},
        {"op": "eq", "col": 0},
        {"op": "and", "children": [{"op": "eq", "col": 0, "val": 1}]},
        {"op": "not", "children": []},
        {"op": "contains", "col": 0, "val": 1},
        "eq",
    ],
)
def test_bad_predicates(spec):
    with pytest.raises(PlanError):
        P.parse(spec)


def test_literal_goes_before_second_column():
    assert isinstance(P.parse({"op": "eq", "col": 0, "val": 1, "col2": 1}), P.CompareLiteral)


def test_position_out_of_range():
    with pytest.raises(PlanError):
        P.check(P.parse({"op": "eq", "col": 0, "col2": 5}), (I, I))


def test_text_grouping():
    a, b, c = (parse_text(f"t.{i} = 1").tree for i in range(3))
    assert parse_text("t.0 = 1 or t.1 = 1 and t.2 = 1").tree == ("and", ("or", a, b), c)
    assert parse_text("not t.0 = 1 and t.1 = 1").tree == ("and", ("not", a), b)
    assert parse_text("t.0 = 1 or (t.1 = 1 and t.2 = 1)").tree == ("or", a, ("and", b, c))


def test_text_lowering():
    flat = lambda r, i: i
    assert parse_text("t.3 >= 8").to_json(flat) == {"op": "not", "children": [{"op": "lt", "col": 3, "val": 8}]}
    assert parse_text("t.3 <= 8.5").to_json(flat) == {"op": "not", "children": [{"op": "gt", "col": 3, "val": 8.5}]}
    assert parse_text("t.3 != u.1").to_json(flat) == {"op": "not", "children": [{"op": "eq", "col": 3, "col2": 1}]}
    assert parse_text(r't.1 contains "say \"hi\" \\"').to_json(flat)["val"] == 'say "hi" \\'


def test_text_analysis():
    p = parse_text("a.0 = b.2")
    assert p.required_columns() == {("a", 0), ("b", 2)}
    assert p.is_join_predicate_for({"a"}, {"b"}) and p.is_equijoin_predicate_for({"b", "c"}, {"a"})
    assert not p.is_join_predicate_for({"a"}, {"c"})
    assert not parse_text("a.0 > b.2").is_equijoin_predicate_for({"a"}, {"b"})
    assert parse_text("a.0 > b.2 and a.1 = 3").is_join_predicate_for({"a"}, {"b"})


@pytest.mark.parametrize("text", ["", "t.0", "t.0 =", "t.0 = 1 and", "(t.0 = 1", "t.0 = 1)", "t.0 = -1", 't.0 = "x"', "t.0 contains 3", "x = 1", "t.0 ~ 1"])
def test_bad_text(text):
    with pytest.raises(PlanError):
        parse_text(text)
