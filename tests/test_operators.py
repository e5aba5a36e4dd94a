import math
import random

import pytest
from helpers import plain, relation, rows

from planframe.errors import PlanTypeError
from planframe.functions import predicate as P
from planframe.operators import groupby, joins
from planframe.operators.rowwise import project, where
from planframe.operators.sort import sort
from planframe.operators.zip import zip_relations

NAN = float("nan")
EQ01 = P.parse({"op": "eq", "col": 0, "col2": 1})


def test_project_reorders_and_repeats(spark):
    rel = relation(spark, "it", [(1, "a"), (2, "b")])
    out = project(rel, [1, 0, 1])
    assert rows(out) == [("a", 1, "a"), ("b", 2, "b")] and [t.value for t in out.types] == ["TEXT", "INTEGER", "TEXT"]


def test_filters_and_projects_compose(spark):
    rel = relation(spark, "ii", [(1, 9), (2, 8), (3, 7)])
    p = P.parse({"op": "gt", "col": 0, "val": 7})
    assert rows(where(project(rel, [1]), p)) == [(9,), (8,)]
    assert rows(project(project(rel, [1, 0]), [1])) == [(1,), (2,), (3,)]
    assert rows(where(where(rel, P.parse({"op": "gt", "col": 0, "val": 1})), P.parse({"op": "lt", "col": 1, "val": 8}))) == [(3, 7)]


JOINS = {
    "loop": lambda a, b, lit: joins.loop_join(a, b, P.parse({"op": "eq", "col": 0, "col2": len(a.types)}), lit),
    "merge": lambda a, b, lit: joins.merge_join(a, b, [0], [0], lit),
    "hash": lambda a, b, lit: joins.hash_join(a, b, [0], [0], lit),
}


@pytest.mark.parametrize("literal", [False, True])
@pytest.mark.parametrize("kind", JOINS)
def test_joins(spark, kind, literal):
    join = JOINS[kind]
    out = join(relation(spark, "i", [(5,), (6,), (7,)]), relation(spark, "i", [(5,), (5,), (5,), (8,)]), literal)
    assert rows(out) == [(5, 5)] * 3
    left = relation(spark, "it", [(5, "hello!"), (5, "world"), (7, "does not appear")])
    right = relation(spark, "ii", [(5, 2), (5, 3), (5, 4), (8, 5)])
    assert sorted(rows(join(left, right, literal))) == sorted((5, w, 5, n) for w in ("hello!", "world") for n in (2, 3, 4))


def test_join_order_of_rows(spark):
    left, right = relation(spark, "it", [(1, "a"), (1, "b")]), relation(spark, "ii", [(1, 10), (1, 20)])
    by_right = [(1, "a", 1, 10), (1, "b", 1, 10), (1, "a", 1, 20), (1, "b", 1, 20)]
    assert rows(JOINS["hash"](left, right, False)) == by_right == rows(JOINS["loop"](left, right, False))
    assert rows(JOINS["merge"](left, right, False)) == [(1, "a", 1, 10), (1, "a", 1, 20), (1, "b", 1, 10), (1, "b", 1, 20)]


def test_several_keys_and_none(spark):
    a, b = relation(spark, "ii", [(1, 1), (1, 2)]), relation(spark, "ii", [(1, 2), (2, 1)])
    assert rows(joins.hash_join(a, b, [0, 1], [0, 1])) == [(1, 2, 1, 2)]
    assert rows(joins.merge_join(a, b, [0, 1], [1, 0])) == [(1, 2, 2, 1)]
    assert len(rows(joins.hash_join(a, b, [], []))) == len(rows(joins.merge_join(a, b, [], []))) == 4


def test_keys_of_different_types(spark):
    a, b = relation(spark, "i", [(1,)]), relation(spark, "r", [(1.0,)])
    assert rows(joins.hash_join(a, b, [0], [0])) == [] == rows(joins.loop_join(a, b, EQ01))


def test_nan_and_zero_keys(spark):
    a, b = relation(spark, "r", [(NAN,), (0.0,)]), relation(spark, "r", [(NAN,), (-0.0,)])
    assert len(rows(joins.hash_join(a, b, [0], [0]))) == 2 == len(rows(joins.merge_join(a, b, [0], [0])))


def test_theta(spark):
    p = P.parse({"op": "gt", "col": 0, "col2": 1})
    assert sorted(rows(joins.loop_join(relation(spark, "i", [(1,), (3,)]), relation(spark, "i", [(0,), (2,)]), p))) == [(1, 0), (3, 0), (3, 2)]


DATA = [(1, 1), (1, 10), (2, -15)]
AGGS = [("count", 0), ("sum", 1)]


def test_group_bys(spark):
    rel = relation(spark, "ii", DATA)
    expected = [(1, 1, 2, 11), (2, -15, 1, -15)]
    assert rows(groupby.hashed_group_by(rel, 0, AGGS)) == expected
    assert rows(groupby.sorted_group_by(rel, 0, AGGS)) == expected
    assert rows(groupby.sorted_group_by(sort(rel, [0]), 0, AGGS)) == expected
    assert rows(groupby.all_rows_group_by(rel, AGGS)) == [(1, 1, 3, -4)]


def test_runs(spark):
    rel = relation(spark, "i", [(1,), (1,), (2,), (1,)])
    assert rows(groupby.sorted_group_by(rel, 0, [("count", 0)])) == [(1, 2), (2, 1), (1, 1)]


def test_long_runs_across_ranges(spark):
    random.seed(2)
    keys = [k for k in (random.randint(0, 3) for _ in range(60)) for _ in range(random.randint(1, 90))]
    expected = []
    for k in keys:
        if expected and expected[-1][0] == k:
            expected[-1][1] += 1
        else:
            expected.append([k, 1])
    assert rows(groupby.sorted_group_by(relation(spark, "i", [(k,) for k in keys]), 0, [("count", 0)])) == [tuple(e) for e in expected]


def test_runs_of_nan(spark):
    rel = relation(spark, "r", [(NAN,), (NAN,), (0.0,), (-0.0,)])
    assert [r[1] for r in rows(groupby.sorted_group_by(rel, 0, [("count", 0)]))] == [2, 2]


def test_empty_inputs(spark):
    rel = relation(spark, "ii", [])
    assert rows(groupby.hashed_group_by(rel, 0, AGGS)) == rows(groupby.sorted_group_by(rel, 0, AGGS)) == rows(groupby.all_rows_group_by(rel, AGGS)) == []
    assert rows(zip_relations([rel, relation(spark, "i", [(1,)])])) == []
    assert rows(joins.hash_join(rel, rel, [0], [0])) == []


def test_witness_is_one_row(spark):
    rel = sort(relation(spark, "iti", [(1, "z", 3), (1, "a", 1), (1, "m", 2)]), [2])
    assert rows(groupby.hashed_group_by(rel, 0, [("count", 0)])) == [(1, "a", 1, 3)]
    assert rows(groupby.all_rows_group_by(rel, [("max", 2)])) == [(1, "a", 1, 3)]


def test_aggregates(spark):
    rel = relation(spark, "i", [(500,), (-200,), (12,)])
    out = groupby.all_rows_group_by(rel, [("min", 0), ("max", 0), ("avg", 0), ("count", 0), ("sum", 0)])
    assert rows(out) == [(500, -200, 500, 104.0, 3, 312)]
    assert [t.value for t in out.types] == ["INTEGER", "INTEGER", "INTEGER", "REAL", "INTEGER", "INTEGER"]


def test_aggregates_of_other_types(spark):
    rel = relation(spark, "rtb", [(NAN, "b", b"\x80"), (1.0, "a", b"\x01\x02")])
    (_, _, _, low, high, first, last, least, most), = rows(groupby.all_rows_group_by(rel, [("min", 0), ("max", 0), ("min", 1), ("max", 1), ("min", 2), ("max", 2)]))
    assert low == 1.0 and math.isnan(high) and (first, last) == ("a", "b") and (plain(least), plain(most)) == (b"\x01\x02", b"\x80")


def test_average_of_one_integer_is_real(spark):
    assert type(rows(groupby.all_rows_group_by(relation(spark, "i", [(3,)]), [("avg", 0)]))[0][1]) is float


@pytest.mark.parametrize("letters", ["t", "b"])
def test_no_sums_of_text(spark, letters):
    with pytest.raises(PlanTypeError):
        groupby.all_rows_group_by(relation(spark, letters, []), [("sum", 0)])


def test_overflow_is_an_error(spark):
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW"):
        rows(groupby.all_rows_group_by(relation(spark, "i", [((1 << 63) - 1,), (1,)]), [("sum", 0)]))


def test_sort(spark):
    assert rows(sort(relation(spark, "i", [(-50,), (-90,), (40,), (0,), (19,)]), [0])) == [(-90,), (-50,), (0,), (19,), (40,)]
    random.seed(1)
    data = [(random.randint(-5, 5), random.randint(-(1 << 60), 1 << 60)) for _ in range(20_005)]
    assert rows(sort(relation(spark, "ii", data), [0, 1])) == sorted(data)


def test_sort_keeps_ties_in_order_and_puts_nan_last(spark):
    rel = relation(spark, "it", [(1, "b"), (0, "x"), (1, "a")])
    assert rows(sort(rel, [0])) == [(0, "x"), (1, "b"), (1, "a")]
    assert math.isnan(rows(sort(relation(spark, "r", [(NAN,), (float("inf"),), (-1.0,)]), [0]))[-1][0])


def test_zip(spark):
    assert rows(zip_relations([relation(spark, "i", [(-5,), (-7,), (-9,)]), relation(spark, "i", [(5,), (6,), (7,)])])) == [(-5, 5), (-7, 6), (-9, 7)]
    wide = zip_relations([relation(spark, "i", [(i,) for i in range(45)]), relation(spark, "ii", [(2 * i, 3 * i) for i in range(45)])])
    assert rows(wide) == [(i, 2 * i, 3 * i) for i in range(45)]
    one = relation(spark, "i", [(1,)])
    assert zip_relations([one]) is one


def test_zip_is_as_long_as_the_shortest(spark):
    a, b = relation(spark, "i", [(i,) for i in range(5)]), relation(spark, "i", [(i,) for i in range(3)])
    assert rows(zip_relations([a, b, a])) == [(i, i, i) for i in range(3)]


def test_zip_many_ranges(spark):
    n = 5000
    a, b = relation(spark, "i", [(i,) for i in range(n)]), relation(spark, "i", [(-i,) for i in range(n)])
    assert rows(zip_relations([a, sort(b, [0])])) == [(i, i - n + 1) for i in range(n)]
