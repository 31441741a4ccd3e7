"""Summaries and table comparison."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stepframe.operators import sets as U
from stepframe.operators import summary as A
from stepframe.operators import tracking as B


@pytest.fixture(scope="module")
def rated(spark):
    return spark.createDataFrame([(5, 10.0), (5, None), (4, 70.0), (None, 50.0)], "rating int, cost double")


def test_class_means(rated, as_rows):
    got = A.class_means(rated, ["rating"], {"mean": F.avg("cost")})
    assert got.columns == ["rating", "_TYPE_", "_FREQ_", "mean"]
    assert as_rows(got) == [(None, 0, 3, 40.0), (4, 1, 1, 70.0), (5, 1, 2, 10.0)]


def test_class_means_with_missing_level(rated, as_rows):
    got = A.class_means(rated, ["rating"], {"mean": F.avg("cost")}, include_missing=True)
    assert as_rows(got) == [(None, 0, 4, 130 / 3), (None, 1, 1, 50.0), (4, 1, 1, 70.0), (5, 1, 2, 10.0)]


@pytest.mark.parametrize("keep", [True, False])
def test_named_statistics_equal_plain_aggregates(spark, keep):
    df = spark.range(500).selectExpr("nullif(id % 3, 2) AS a", "nullif(id % 7, 5) AS b", "id % 2 AS c",
                                     "CAST(nullif(id % 11, 4) AS DOUBLE) AS v", "nullif(id, 77) AS w")
    classes = ["a", "b", "c"]
    named = A.class_means(df, classes, {"n": ("n", "v"), "s": ("sum", "v"), "m": ("mean", "v"), "lo": ("min", "w"),
                                        "hi": ("max", "w"), "mw": ("mean", "w")}, include_missing=keep)
    plain = A.class_means(df, classes, {"n": F.count("v"), "s": F.sum("v"), "m": F.avg("v"), "lo": F.min("w"),
                                        "hi": F.max("w"), "mw": F.avg("w")}, include_missing=keep)
    assert named.columns == plain.columns and named.dtypes == plain.dtypes
    assert U.compare_verdict(named, plain).first().verdict == "PASS"


def test_class_means_of_no_rows(spark, as_rows):
    df = spark.createDataFrame([], "a int, v double")
    for stats in ({"m": ("mean", "v"), "n": ("n", "v")}, {"m": F.avg("v"), "n": F.count("v")}):
        assert as_rows(A.class_means(df, ["a"], stats)) == []


def test_class_means_types_and_nway(spark, as_rows):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "c1 string, c2 string, v int")
    stats = {"total": F.sum("v")}
    every = A.class_means(df, ["c1", "c2"], stats)
    assert {r._TYPE_ for r in every.collect()} == {0, 1, 2, 3}
    ones = [r for r in every.collect() if r._TYPE_ == 2]
    assert {(r.c1, r.c2, r.total) for r in ones} == {("a", None, 3), ("b", None, 3)}
    nway = A.class_means(df, ["c1", "c2"], stats, nway=True)
    assert as_rows(nway) == [("a", "x", 3, 1, 1), ("a", "y", 3, 1, 2), ("b", "x", 3, 1, 3)]
    assert A.class_types(2, 1) == [2, 1]
    some = A.class_means(df, ["c1", "c2"], stats, types=A.class_types(2, 1))
    assert {r._TYPE_ for r in some.collect()} == {1, 2}


def test_freq(rated, as_rows):
    got = {r.rating: (r.COUNT, r.PERCENT) for r in A.freq_oneway(rated, "rating").collect()}
    assert got[None] == (1, None)
    assert got[5][0] == 2 and abs(got[5][1] - 200 / 3) < 1e-9
    whole = {r.rating: r.PERCENT for r in A.freq_oneway(rated, "rating", include_missing=True).collect()}
    assert whole == {None: 25.0, 4: 25.0, 5: 50.0}


def test_progress_rounds_down(spark, as_rows):
    df = spark.createDataFrame([("p", True), ("p", True), ("p", False), ("q", True)], "project string, done boolean")
    assert as_rows(A.progress_percent(df, ["project"], F.col("done"))) == [("p", 3, 2, 66), ("q", 1, 1, 100)]


def test_conversion_time(spark):
    df = spark.sql("""SELECT * FROM VALUES
        ('p', TIMESTAMP_NTZ '2024-01-01 00:00:00', TIMESTAMP_NTZ '2024-01-02 01:01:01.5'),
        ('p', TIMESTAMP_NTZ '2024-01-01 00:00:00', NULL) AS t(project, started, done)""")
    row = A.conversion_time_stats(df, ["project"], "started", "done", {"latest": F.max("done")}).first()
    assert (row.files_converted, row.avg_conversion_seconds) == (1, 86400 + 3600 + 61.5)


def test_return_codes(spark, as_rows):
    df = spark.createDataFrame([("j", "a", 0), ("j", "a", 4), ("j", "b", 8), ("k", "a", 0)], "job string, step string, code int")
    assert as_rows(A.return_code_rollup(df, "job", "step", "code")) == [
        ("j", None, "job", 8), ("j", "a", "step", 4), ("j", "b", "step", 8), ("k", None, "job", 0), ("k", "a", "step", 0)]


@pytest.mark.parametrize("exact", [True, False])
def test_profile(spark, exact):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "b")], "n int, t string")
    got = {r.column_name: tuple(r)[1:] for r in A.column_profile(df, exact=exact).collect()}
    assert got == {"n": (3, 0, 2, "1", "2", 5 / 3), "t": (3, 1, 2, "a", "b", None)}
    assert [r.column_name for r in A.column_profile(df, ["t"]).collect()] == ["t"]


def test_dashboard(spark, as_rows):
    owners = spark.createDataFrame([("u",), ("w",)], "user_id string")
    projects = spark.createDataFrame([("u", 1, "ready"), ("u", 2, "completed"), ("u", 3, "analyzing")],
                                     "user_id string, project_id int, status string")
    tasks = spark.createDataFrame([(1, "pending"), (1, "converted"), (2, "approved"), (2, "converting")],
                                  "project_id int, status string")
    assert as_rows(B.status_dashboard(owners, projects, tasks)) == [
        ("u", 3, 1, 1, 4, 1, 2, 1), ("w", 0, 0, 0, 0, 0, 0, 0)]


def test_monthly_usage(spark, as_rows):
    df = spark.sql("""SELECT * FROM VALUES ('u', TIMESTAMP_NTZ '2024-01-05 00:00:00'),
        ('u', TIMESTAMP_NTZ '2024-01-06 00:00:00'), ('u', TIMESTAMP_NTZ '2024-02-01 00:00:00') AS t(user_id, ts)""")
    assert as_rows(B.monthly_usage(df)) == [("u", 2024, 1, 2, 1000, 998), ("u", 2024, 2, 1, 1000, 999)]
    limits = spark.createDataFrame([("u", 1)], "user_id string, monthly_request_limit int")
    assert [r.remaining for r in B.monthly_usage(df, limits).orderBy("month").collect()] == [0, 0]


def test_stacking(spark, as_rows):
    a = spark.createDataFrame([(1, "x")], "n int, t string")
    b = spark.createDataFrame([("y", 2), ("y", 2)], "t string, n int")
    c = spark.createDataFrame([(3,)], "n int")
    assert as_rows(U.set_concat([a, b, c], "src")) == [(1, "x", 1), (2, "y", 2), (2, "y", 2), (3, None, 3)]
    assert as_rows(U.union_distinct([b, b])) == [("y", 2)]


cells = st.lists(st.tuples(st.integers(0, 8), st.one_of(st.none(), st.integers(0, 3))), max_size=12)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=cells, b=cells)
def test_compare_without_keys(spark, a, b):
    x = spark.createDataFrame(a, "k int, v int")
    y = spark.createDataFrame(b, "k int, v int")
    assert U.dataset_compare(x, x).count() == 0
    got = {(r.side, r.k, r.v): r.surplus for r in U.dataset_compare(x, y).collect()}
    want = {}
    for row in set(a) | set(b):
        d = a.count(row) - b.count(row)
        if d:
            want[("only_a" if d > 0 else "only_b", *row)] = abs(d)
    assert got == want
    back = {(r.side, r.k, r.v): r.surplus for r in U.dataset_compare(y, x).collect()}
    flip = {"only_a": "only_b", "only_b": "only_a"}
    assert back == {(flip[s], k, v): n for (s, k, v), n in want.items()}


def test_compare_with_keys(spark, as_rows):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, None), (3, 3.0, "z")], "k int, v double, t string")
    b = spark.createDataFrame([(1, 1.05, "x"), (2, 2.0, "y"), (4, 3.0, "z")], "k int, v double, t string")
    assert as_rows(U.dataset_compare(a, b, ["k"])) == [
        (1, "changed", "v", "1.0", "1.05"), (2, "changed", "t", None, "y"), (3, "only_a", None, None, None),
        (4, "only_b", None, None, None)]
    loose = U.compare_verdict(a, b, ["k"], tol=0.1).first()
    assert (loose.n_only_a, loose.n_only_b, loose.n_changed, loose.verdict) == (1, 1, 1, "FAIL")
    assert U.compare_verdict(a, a, ["k"]).first().verdict == "PASS"
    assert U.compare_verdict(a, a).first().verdict == "PASS"
