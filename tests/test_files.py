import glob

import pytest
from helpers import relation, rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from planframe import PlanBuilder
from planframe.errors import PlanError, PlanTypeError
from planframe.functions.text import render
from planframe.sources import read_columns, read_csv, write_columnar, write_csv
from planframe.types import LETTERS, LogicalType

b = PlanBuilder()


def types(letters):
    return [LETTERS[c] for c in letters]


def read(spark, tmp_path, text, letters, **how):
    (tmp_path / "in.csv").write_text(text)
    return rows(read_csv(spark, str(tmp_path / "in.csv"), types(letters), **how))


def test_header_is_skipped(spark, tmp_path):
    assert read(spark, tmp_path, "a,b,c\n1,2,3\n4,5,6\n7,8,9\n", "iii") == [(1, 2, 3), (4, 5, 6), (7, 8, 9)]
    assert read(spark, tmp_path, "a,b,c\n1,hi,3\n4,hello,6\n", "iti") == [(1, "hi", 3), (4, "hello", 6)]
    assert read(spark, tmp_path, "1,x\n", "it", header=False) == [(1, "x")]


def test_what_does_not_parse_is_the_default(spark, tmp_path):
    cells = [" 5", "5.7", "99999999999999999999", "", "1e3", "+7", "-8", "9223372036854775807", "+"]
    got = read(spark, tmp_path, "h,x\n" + "".join(f"{c},x\n" for c in cells), "it")
    assert [r[0] for r in got] == [0, 0, 0, 0, 0, 7, -8, 9223372036854775807, 0]
    cells = ["1d", "0x1p3", " 5", "", ".", "5.", "-.5", "1e3", "-inf", "Infinity"]
    got = read(spark, tmp_path, "h,x\n" + "".join(f"{c},x\n" for c in cells), "rt")
    assert [r[0] for r in got] == [0.0, 0.0, 0.0, 0.0, 0.0, 5.0, -0.5, 1000.0, float("-inf"), float("inf")]


def test_quotes_and_line_ends(spark, tmp_path):
    text = 'a,b\n1,"x, ""y"""\n2,"two\nlines"\n3,\n4," keep "\n'
    assert read(spark, tmp_path, text, "it") == [(1, 'x, "y"'), (2, "two\nlines"), (3, ""), (4, " keep ")]


@pytest.mark.parametrize("row", ["1\n", "1,2,3\n"])
def test_ragged_rows_are_errors(spark, tmp_path, row):
    with pytest.raises(Exception, match="MALFORMED"):
        read(spark, tmp_path, "a,b\n1,2\n" + row, "ii")


def test_blobs_are_raw_bytes(spark, tmp_path):
    assert bytes(read(spark, tmp_path, "a,b\nYWI=,1\n", "bi")[0][0]) == b"YWI="


def test_csv_out(spark, tmp_path):
    rel = relation(spark, "it", [(5, "hello"), (6, "world!"), (7, "test,test"), (8, " keep "), (9, 'q"q')])
    write_csv(rel, str(tmp_path / "o"), single_file=True)
    (part,) = glob.glob(str(tmp_path / "o/part-*"))
    assert open(part).read() == '5,hello\n6,world!\n7,"test,test"\n8, keep \n9,"q""q"\n'


def test_csv_out_and_back_loses_the_first_row_without_a_header(spark, tmp_path):
    rel = relation(spark, "i", [(5,), (6,), (7,)])
    write_csv(rel, str(tmp_path / "o"), single_file=True)
    assert rows(read_csv(spark, str(tmp_path / "o"), types("i"))) == [(6,), (7,)]
    write_csv(rel, str(tmp_path / "o"), header=["n"], single_file=True)
    assert rows(read_csv(spark, str(tmp_path / "o"), types("i"))) == [(5,), (6,), (7,)]


def test_rendering_of_reals(spark):
    values = {1.0: "1", 0.1: "0.1", 1e20: "100000000000000000000", 1.5e-7: "0.00000015", -2.5e10: "-25000000000", 123456789.125: "123456789.125", 1.2345e8: "123450000", float("inf"): "inf", float("-inf"): "-inf", -0.0: "-0"}
    df = spark.createDataFrame([(v,) for v in values], "x double").select(render(F.col("x"), LogicalType.REAL))
    assert [r[0] for r in df.collect()] == list(values.values())
    assert spark.sql("select double('NaN') x").select(render(F.col("x"), LogicalType.REAL)).first()[0] == "NaN"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=1, max_size=20))
def test_rendered_reals_read_back(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double").select(render(F.col("x"), LogicalType.REAL))
    got = [r[0] for r in df.collect()]
    assert [float(g) for g in got] == values and not any("e" in g.lower() for g in got)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-(1 << 63), (1 << 63) - 1), st.text(st.characters(blacklist_categories=["Cs", "Cc"]), max_size=8)), min_size=1, max_size=10))
def test_csv_round_trip(spark, tmp_path_factory, data):
    path = str(tmp_path_factory.mktemp("rt") / "x.csv")
    write_csv(relation(spark, "it", data), path, header=["a", "b"], single_file=True)
    assert rows(read_csv(spark, path, types("it"))) == data


def test_csv_to_columnar_to_zip(spark, tmp_path):
    (tmp_path / "in.csv").write_text("a,b,c\n" + "".join(f"{i},{'x' * (i % 7)},{i / 8}\n" for i in range(500)))
    source = b.csv_read().file(str(tmp_path / "in.csv")).types("itr")
    b.columnar_out(source).file(str(tmp_path / "col")).compile().execute(spark)
    back = b.union(*[b.columnar_read().file(str(tmp_path / "col")).col(i).type(t) for i, t in enumerate(["INTEGER", "TEXT", "REAL"])])
    assert back.compile().to_dataframe(spark).collect() == source.compile().to_dataframe(spark).collect()


def test_columnar_types_are_checked(spark, tmp_path):
    path = str(tmp_path / "x")
    write_columnar(relation(spark, "ib", [(1, b"\x00\x80")]), path)
    assert bytes(rows(read_columns(spark, path, [1, 0]))[0][0]) == b"\x00\x80"
    with pytest.raises(PlanTypeError):
        read_columns(spark, path, [0], [LogicalType.TEXT])
    with pytest.raises(PlanError):
        read_columns(spark, path, [2])
    spark.sql("select array(1) a, 1 i, timestamp_ntz '1970-01-01 00:00:01' t, float(0.5) f").write.parquet(str(tmp_path / "y"))
    assert rows(read_columns(spark, str(tmp_path / "y"), [1, 2, 3])) == [(1, 1_000_000, 0.5)]
    with pytest.raises(PlanTypeError):
        read_columns(spark, str(tmp_path / "y"), [0])


def test_sorted_output_stays_sorted(spark, tmp_path):
    (tmp_path / "in.csv").write_text("a\n" + "".join(f"{(i * 7919) % 1000}\n" for i in range(1000)))
    s = b.sort(b.csv_read().file(str(tmp_path / "in.csv")).types("i")).cols([0])
    b.columnar_out(s).file(str(tmp_path / "col")).compile().execute(spark)
    back = b.columnar_read().file(str(tmp_path / "col")).col(0).type("INTEGER").compile()
    assert rows(back.relation(spark)) == [(i,) for i in range(1000)]
