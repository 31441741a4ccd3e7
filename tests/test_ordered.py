"""Numbering and running values: the window way and the way for large groups agree."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stepframe.operators import ordered as W
from stepframe.operators.sets import compare_verdict


def skewed(spark, n=3000, seed=3):
    """A third of the rows in one group, some rows without a group, unique order numbers."""
    rnd = random.Random(seed)
    data = [(None if i % 50 == 0 else ("hot" if i % 3 == 0 else f"g{rnd.randrange(40)}"), i,
             None if rnd.random() < .6 else rnd.randrange(100)) for i in range(n)]
    rnd.shuffle(data)
    return spark.createDataFrame(data, "g string, i bigint, v bigint").repartition(7)


def expected_running(df):
    count, total, last, out = {}, {}, {}, {}
    for r in sorted(df.collect(), key=lambda r: r.i):
        count[r.g] = count.get(r.g, 0) + 1
        total[r.g] = total.get(r.g, 0) + (r.v or 0)
        last[r.g] = r.v if r.v is not None else last.get(r.g)
        out[r.i] = (count[r.g], total[r.g], last[r.g])
    return out


@pytest.mark.parametrize("options", [
    {"path": "window"}, {"path": "chunked"}, {"hot_rows": 200}, {"hot_rows": 1}, {}])
def test_running_matches_plain_loop(spark, options):
    df = skewed(spark)
    got = W.running(df, ["g"], ["i"], {"n": F.lit(1), "s": F.col("v")}, {"l": F.col("v")}, **options)
    assert got.columns == ["g", "i", "v", "n", "s", "l"]
    assert {r.i: (r.n, r.s, r.l) for r in got.collect()} == expected_running(df)


def test_running_over_the_whole_table(spark):
    df = skewed(spark)
    got = W.retain_counter(df, [], ["i"], F.col("v") > 50, start=10)
    n, want = 10, {}
    for r in sorted(df.collect(), key=lambda r: r.i):
        n += 1 if r.v is not None and r.v > 50 else 0
        want[r.i] = n
    assert {r.i: r.counter for r in got.collect()} == want


def test_descending_order(spark):
    df = skewed(spark, 500)
    plain = W.positions(df, ["g"], [F.col("i").desc()], path="window")
    chunked = W.positions(df, ["g"], [F.col("i").desc()], hot_rows=20)
    assert compare_verdict(plain, chunked, ["i"]).first().verdict == "PASS"


def test_split_hot_keeps_every_row(spark):
    df = skewed(spark)
    rest, hot = W.split_hot(df, ["g"], 500)
    assert {r.g for r in hot.select("g").distinct().collect()} == {"hot"}
    assert rest.count() + hot.count() == df.count()
    assert W.split_hot(df, ["g"], 10 ** 6)[1] is None


def test_hot_missing_group(spark):
    df = spark.range(400).select(F.lit(None).cast("string").alias("g"), F.col("id").alias("i"))
    got = W.positions(df, ["g"], ["i"], hot_rows=100)
    assert sorted((r.i, r.rn) for r in got.collect()) == [(i, i + 1) for i in range(400)]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(-50, 50), max_size=40), start=st.integers(0, 9))
def test_dense_row_id_is_gap_free(spark, values, start):
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int").repartition(5)
    got = W.dense_row_id(df, ["v", "i"], start, "id").collect()
    order = sorted((v, i) for i, v in enumerate(values))
    assert sorted((r.id, (r.v, r.i)) for r in got) == [(start + n, o) for n, o in enumerate(order)]


def parts(spark):
    target = spark.createDataFrame([("a", 10, "old a"), ("c", 40, "old c"), ("z", 7, "old z")],
                                   "bk string, id bigint, note string")
    source = spark.createDataFrame([("d", 1), ("a", 2), ("b", 3), ("b", 4), ("c", 5), ("a", 6)],
                                   "bk string, seq int")
    return source, target


def test_new_keys(spark, as_rows):
    source, target = parts(spark)
    got = W.surrogate_keys(source, target, ["bk"], "id", ["seq"])
    assert as_rows(got.select("bk", "seq", "id", "note")) == [
        ("a", 2, 10, "old a"), ("a", 6, 10, "old a"), ("b", 3, 41, None), ("b", 4, 42, None),
        ("c", 5, 40, "old c"), ("d", 1, 43, None)]


def test_new_keys_keep_all(spark, as_rows):
    source, target = parts(spark)
    got = W.surrogate_keys(source, target, ["bk"], "id", ["seq"], keep="all")
    assert ("z", None, 7, "old z") in as_rows(got.select("bk", "seq", "id", "note"))
    assert got.count() == 7


def test_all_keys_and_starts(spark):
    source, target = parts(spark)
    every = W.surrogate_keys(source, target, ["bk"], "id", ["seq"], mode="all")
    assert sorted((r.seq, r.id) for r in every.collect()) == [(i, 40 + i) for i in range(1, 7)]
    fixed = W.surrogate_keys(source, None, ["bk"], "id", ["seq"], mode="all", start_from=100)
    assert sorted(r.id for r in fixed.collect()) == list(range(100, 106))
    lookup = spark.createDataFrame([(500,)], "last_key bigint")
    looked = W.surrogate_keys(source, None, ["bk"], "id", ["seq"], mode="all", start_from=lookup)
    assert min(r.id for r in looked.collect()) == 501
    assert W.advance_lookup(lookup, source).first()[0] == 506
    assert W.advance_lookup(lookup, source, target, ["bk"]).first()[0] == 503
    empty = target.where("id < 0")
    first = W.surrogate_keys(source, empty, ["bk"], "id", ["seq"])
    assert sorted(r.id for r in first.collect()) == list(range(1, 7))
    with pytest.raises(ValueError):
        W.surrogate_keys(source, target, ["bk"], "id", ["seq"], start_from="elsewhere")


def test_missing_business_key_matches_missing(spark):
    source = spark.createDataFrame([(None, 1), ("b", 2)], "bk string, seq int")
    target = spark.createDataFrame([(None, 5)], "bk string, id bigint")
    got = W.surrogate_keys(source, target, ["bk"], "id", ["seq"])
    assert {r.seq: r.id for r in got.collect()} == {1: 5, 2: 6}


def test_having_remerge_keeps_ties(spark, as_rows):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 3.0), ("d", None)], "n string, v double")
    assert as_rows(W.having_remerge(df, "v")) == [("b", 3.0), ("c", 3.0)]
    g = spark.createDataFrame([("x", 1), ("x", 2), ("y", 2), (None, 9)], "g string, v int")
    assert as_rows(W.having_remerge(g, "v", by=["g"])) == [(None, 9), ("x", 2), ("y", 2)]


def test_first_last(spark, as_rows):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4)], "g string, i int")
    assert as_rows(W.first_last_flags(df, "i", ["g"])) == [
        ("a", 1, True, False), ("a", 2, False, False), ("a", 3, False, True), ("b", 4, True, True)]
    assert [r[2:] for r in as_rows(W.first_last_flags(df, "i"))] == [
        (True, False), (False, False), (False, False), (False, True)]


def test_usage_limit(spark):
    df = spark.createDataFrame([("u", i, i) for i in range(5)] + [("w", 1, 9)], "u string, at int, id int")
    got = W.usage_limit_flag(df, ["u"], ["at", "id"], 3, "id")
    assert sorted((r.id, r.accepted, r.used_after) for r in got.collect()) == [
        (0, True, 1), (1, True, 2), (2, True, 3), (3, False, 3), (4, False, 3), (9, True, 1)]


def test_versions_and_first_match(spark, as_rows):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 5, "z")], "k string, at int, code string")
    assert as_rows(W.versions(df, ["k"], ["at"]).select("k", "at", "version")) == [
        ("a", 1, 2), ("a", 2, 3), ("b", 5, 2)]
    assert as_rows(W.latest_version(df, ["k"], ["at"], ["code"])) == [("a", 3, "y"), ("b", 2, "z")]
    assert as_rows(W.first_match(df, ["k"], ["at"])) == [("a", 1, "x"), ("b", 5, "z")]


def test_top_n_is_cut_before_the_shuffle(spark):
    df = skewed(spark)
    plan = W.top_n_per_group(df, ["g"], [F.col("i").desc()], 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_max_key_of_empty_table(spark):
    df = spark.createDataFrame([], "k bigint")
    assert spark.range(1).select(W.max_key(df, "k").alias("m")).first().m == 0


@pytest.mark.parametrize("path", ["window", "chunked"])
def test_existing_output_column_is_replaced(spark, path):
    df = spark.range(5).selectExpr("id % 2 AS g", "id AS i", "99 AS rn")
    got = W.positions(df, ["g"], ["i"], path=path)
    assert sorted(got.columns) == ["g", "i", "rn"]
    assert sorted((r.i, r.rn) for r in got.collect()) == [(0, 1), (1, 1), (2, 2), (3, 2), (4, 3)]


def test_source_key_column_is_replaced(spark):
    source, target = parts(spark)
    got = W.surrogate_keys(source.withColumn("id", F.lit(-1)), target, ["bk"], "id", ["seq"])
    assert {r.seq: r.id for r in got.collect()} == {1: 43, 2: 10, 3: 41, 4: 42, 5: 40, 6: 10}
