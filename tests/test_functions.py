"""Edge rules of the column functions."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepframe import functions as fn


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def number(v):
    return F.lit(v).cast("double")


@pytest.mark.parametrize("a,b,lt,le,gt,ge", [
    (None, 5.0, True, True, False, False),
    (None, None, False, True, False, True),
    (5.0, None, False, False, True, True),
    (4.0, 5.0, True, True, False, False),
    (5.0, 5.0, False, True, False, True),
])
def test_missing_is_lowest(spark, a, b, lt, le, gt, ge):
    x, y = number(a), number(b)
    got = spark.range(1).select(fn.missing_lt(x, y), fn.missing_le(x, y), fn.missing_gt(x, y),
                                fn.missing_ge(x, y)).first()
    assert tuple(got) == (lt, le, gt, ge)


@pytest.mark.parametrize("value,band", [
    (None, 5), (-3.0, 5), (49.9, 5), (50.0, None), (50.1, 4), (100.0, None), (120.0, 3), (150.0, None),
    (199.9, 2), (200.0, None), (200.1, 1)])
def test_band_ladder_is_strict(spark, value, band):
    ladder = fn.band_ladder(number(value), [50, 100, 150, 200], [5, 4, 3, 2, 1])
    assert one(spark, ladder) == band


def test_band_ladder_without_missing_rule(spark):
    assert one(spark, fn.band_ladder(number(None), [1], ["a", "b"], missing_low=False)) is None
    with pytest.raises(ValueError):
        fn.band_ladder(number(1.0), [1], ["a"])


def test_branches(spark):
    assert one(spark, fn.binary_branch(number(None) > 18, "adult", "minor")) == "minor"
    assert one(spark, fn.binary_branch(number(3.0) > 18, "old", "young")) == "you"
    assert one(spark, fn.ifc(F.lit(None).cast("boolean"), "a", "b")) == "b"


def test_clamp(spark):
    assert [one(spark, fn.clamp(number(v), 0.0, 100.0)) for v in (-5.0, 50.0, 500.0, None)] == \
        [0.0, 50.0, 100.0, None]


def test_blank_text(spark):
    for v, blank in ((None, True), ("", True), ("   ", True), (" a", False)):
        assert one(spark, fn.is_blank(F.lit(v).cast("string"))) is blank
        assert one(spark, fn.not_blank(F.lit(v).cast("string"))) is not blank


@pytest.mark.parametrize("v,right,left", [
    (12.4, "      12", "12"), (2.5, "       3", "3"), (-2.5, "      -3", "-3"), (None, "       .", "."),
    (123456789.0, "********", "********"), (-0.2, "       0", "0")])
def test_put_numeric(spark, v, right, left):
    assert one(spark, fn.put_numeric(number(v), 8)) == right
    assert one(spark, fn.put_numeric(number(v), 8, "left")) == left


def test_put_best(spark):
    assert [one(spark, fn.put_best(number(v))) for v in (12.0, 0.5, None)] == ["12", "0.5", "."]


def test_input_numeric(spark):
    got = [one(spark, fn.input_numeric(F.lit(v))) for v in (
        " 12 ", "1.5", "x", "", "  ", "NaN", "Infinity", "1d", ".", "-1e3", "1 2")]
    assert got == [12.0, 1.5, None, None, None, None, None, None, None, -1000.0, None]


def test_catx_cats_concat(spark):
    null = F.lit(None).cast("string")
    assert one(spark, fn.catx("-", F.lit(" a "), F.lit("  "), null, F.lit("b"))) == "a-b"
    assert one(spark, fn.cats(F.lit(7), F.lit(" +"), null)) == "7+"
    assert one(spark, fn.concat_bars(F.lit("a "), null, ";")) == "a ;"


def test_scan_token(spark):
    text = F.lit("lib..table")
    assert [one(spark, fn.scan_token(text, n, ".")) for n in (1, 2, 3)] == ["lib", "table", ""]


@pytest.mark.parametrize("v,text", [
    (1234.5, "$1,234.50"), (12345.67, "12,345.67"), (123456.78, "123456.78"), (1234567.89, "1234567.9"),
    (123456789.0, "123456789"), (1234567890.0, "*********"), (None, "        ."), (-12.0, "  $-12.00")])
def test_dollar_format(spark, v, text):
    assert one(spark, fn.dollar_format(number(v))) == text


def test_datetime_text(spark):
    ts = F.lit(datetime.datetime(2022, 6, 7, 8, 9, 10))
    assert one(spark, fn.datetime_text(ts)) == "  07JUN2022:08:09:10"
    assert one(spark, fn.datetime_iso(ts)) == "2022-06-07T08:09:10"
    assert one(spark, fn.datetime_iso(F.lit(datetime.datetime(2022, 6, 7, 8, 9, 10, 50)))) == \
        "2022-06-07T08:09:10.000050"


def test_json_field(spark):
    doc = F.lit('{"platform_choice": "PySpark"}')
    assert one(spark, fn.json_field(doc, "platform_choice", "SQL")) == "PySpark"
    assert one(spark, fn.json_field(F.lit("{bad"), "platform_choice", "SQL")) == "SQL"
    assert one(spark, fn.json_field(F.lit("{}"), "x")) is None


def test_paths(spark):
    path = F.lit("/out/jobs/j1/tasks/decide/decision.v2.json")
    assert one(spark, fn.path_stem(path)) == "decision.v2"
    assert one(spark, fn.path_extension(path)) == ".json"
    assert one(spark, fn.path_segment_after(path, "jobs")) == "j1"
    assert one(spark, fn.path_segment_after(F.lit("/a/b"), "jobs")) == ""
    assert one(spark, fn.path_stem(F.lit("/a/readme"))) == "readme"
    assert one(spark, fn.path_extension(F.lit("/a.b/readme"))) == ""


def test_missing_all(spark):
    row = spark.range(1).select(*fn.missing_all([T.StructField("a", T.LongType()),
                                                 T.StructField("b", T.StringType())])).first()
    assert row.asDict() == {"a": None, "b": None}


def test_text_helpers(spark):
    assert one(spark, fn.text_length(F.lit("ab  "))) == 2
    assert one(spark, fn.text_length(F.lit(None).cast("string"))) == 0
    assert one(spark, fn.compress(F.lit(" a b "))) == "ab"
    assert one(spark, fn.text_head(F.lit("x" * 3000))) == "x" * 2000
    assert one(spark, fn.has_text(F.lit(""))) is False
    assert one(spark, fn.in_domain(F.lit(None).cast("string"), ["a"])) is False
