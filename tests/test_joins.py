"""Keyed merge against a row-by-row loop, range joins against brute force, nesting, outer merges."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stepframe.operators import joins as J


def merge_by_loop(tables, key, columns):
    """What a row-by-row merge does: values stay until a table supplies a new row."""
    keys = sorted({r[key] for t in tables for r in t}, key=lambda k: (k is not None, k or 0))
    out = []
    for k in keys:
        groups = [[r for r in t if r[key] == k] for t in tables]
        held = dict.fromkeys(columns)
        for i in range(max(map(len, groups))):
            for g in groups:
                if i < len(g):
                    held.update(g[i])
            out.append((k, i + 1, *[held[c] for c in columns], *[bool(g) for g in groups]))
    return out


def by_position(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


rows_of = st.lists(st.tuples(st.sampled_from([None, 1, 2, 3, 4]), st.one_of(st.none(), st.integers(0, 9))),
                   max_size=14)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=rows_of, b=rows_of, c=rows_of, hot=st.sampled_from([1, 4, None]))
def test_match_merge_equals_loop(spark, a, b, c, hot):
    t1 = [{"k": k, "o1": i, "x": v, "shared": v} for i, (k, v) in enumerate(a)]
    t2 = [{"k": k, "o2": i, "shared": v, "pair": v} for i, (k, v) in enumerate(b)]
    t3 = [{"k": k, "o3": i, "pair": v} for i, (k, v) in enumerate(c)]
    d1 = spark.createDataFrame(t1, "k int, o1 int, x int, shared int")
    d2 = spark.createDataFrame(t2, "k int, o2 int, shared int, pair int")
    d3 = spark.createDataFrame(t3, "k int, o3 int, pair int")
    columns = ["o1", "x", "shared", "o2", "pair", "o3"]
    got = J.match_merge([(d1, ["o1"]), (d2, ["o2"]), (d3, ["o3"])], ["k"], ["in1", "in2", "in3"],
                        hot_rows=hot, position="rn")
    assert got.columns == ["k", *columns, "in1", "in2", "in3", "rn"]
    got = by_position(got.select("k", "rn", *columns, "in1", "in2", "in3"))
    if t1 or t2 or t3:
        assert got == merge_by_loop([t1, t2, t3], "k", columns)
    else:
        assert got == []


def test_match_merge_of_a_large_group(spark):
    rnd = random.Random(1)
    left = [{"k": 0 if i % 3 == 0 else rnd.randrange(1, 60), "o": i, "x": i} for i in range(1500)]
    right = [{"k": rnd.randrange(70), "p": i, "x": -i, "y": i * 2} for i in range(300)]
    d1 = spark.createDataFrame(left, "k int, o int, x int").repartition(6)
    d2 = spark.createDataFrame(right, "k int, p int, x int, y int").repartition(3)
    want = merge_by_loop([left, right], "k", ["o", "x", "p", "y"])
    want = [r[:-2] for r in want]
    for hot in (None, 100, 10):
        got = J.match_merge([(d1, ["o"]), (d2, ["p"])], ["k"], hot_rows=hot, position="rn")
        assert by_position(got.select("k", "rn", "o", "x", "p", "y")) == want


def test_match_merge_shuffles_once(spark):
    a = spark.range(10).selectExpr("id AS k", "id AS o", "id AS x")
    b = spark.range(10).selectExpr("id AS k", "id AS p", "id AS y")
    merged = J.match_merge([(a, ["o"]), (b, ["p"])], ["k"])
    assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_merge_with_presence(spark, as_rows):
    target = spark.createDataFrame([("a", 1, "ta"), ("c", 2, "tc")], "k string, id int, name string")
    source = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, seq int")
    got = J.merge_with_presence((target, ["id"]), (source, ["seq"]), ["k"])
    assert as_rows(got) == [("a", 1, "ta", 1, True), ("a", 1, "ta", 2, True), ("b", None, None, 3, False)]
    every = J.merge_with_presence((target, ["id"]), (source, ["seq"]), ["k"], keep_all=True)
    assert every.count() == 4


def test_full_outer_merge(spark, as_rows):
    left = spark.createDataFrame([(1, "l1", 10), (2, "l2", 20), (None, "l0", 5)], "k int, a string, s int")
    right = spark.createDataFrame([(2, None, "r2"), (3, 30, "r3"), (None, 6, "r0")], "k int, s int, b string")
    assert as_rows(J.full_outer_merge(left, right, ["k"])) == [
        (None, "l0", 6, "r0"), (1, "l1", 10, None), (2, "l2", None, "r2"), (3, None, 30, "r3")]


def test_target_membership(spark, as_rows):
    source = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    target = spark.createDataFrame([(2, "x"), (None, "y")], "k int, v string")
    assert as_rows(J.not_in_target(source, target, ["k"])) == [(1,)]
    assert as_rows(J.in_target(source, target, ["k"])) == [(None,), (2,)]
    assert as_rows(J.in_target(source, target, ["k"], ["v"])) == [(None, "y"), (2, "x")]


def below(a, b):
    return a is None or (b is not None and a <= b)


@pytest.mark.parametrize("missing_low", [True, False])
@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_range_join_equals_brute_force(spark, missing_low, threshold):
    rnd = random.Random(11)

    def value():
        return rnd.choice([None, 0.0, -0.25, 0.5, 1e-9, 1e6, -1e6] + [rnd.uniform(-50, 50) for _ in range(20)])

    values = [(i, value()) for i in range(300)]
    ranges = []
    for i in range(60):
        lo, hi = value(), value()
        if lo is not None and hi is not None and lo > hi and i % 5:
            lo, hi = hi, lo
        ranges.append((i, lo, hi))
    ranges += [(100, 7.0, 7.0), (101, -1e308, 1e308), (102, 0.0, 2.0 ** 20), (103, -3.0, 3.0)]
    if missing_low:
        want = {(i, r) for i, v in values for r, lo, hi in ranges if below(lo, v) and below(v, hi)}
    else:
        want = {(i, r) for i, v in values for r, lo, hi in ranges
                if None not in (v, lo, hi) and lo <= v <= hi}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = J.range_join(spark.createDataFrame(values, "i int, v double"),
                           spark.createDataFrame(ranges, "r int, lo double, hi double"), "v", "lo", "hi",
                           missing_low)
        pairs = [(r.i, r.r) for r in got.collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    assert got.columns == ["i", "v", "r", "lo", "hi"]


def test_range_join_is_an_equality_join(spark):
    facts = spark.range(100).selectExpr("CAST(id AS DOUBLE) AS v")
    bands = spark.range(10).selectExpr("id AS r", "id * 10 AS lo", "id * 10 + 9 AS hi")
    plan = J.range_join(facts, bands, "v", "lo", "hi")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert J.range_join(facts, bands, "v", "lo", "hi").count() == 100


def test_range_join_with_no_ranges(spark):
    facts = spark.range(5).selectExpr("CAST(id AS DOUBLE) AS v")
    bands = spark.createDataFrame([], "lo double, hi double")
    assert J.range_join(facts, bands, "v", "lo", "hi").count() == 0


@pytest.mark.parametrize("hot", [None, 3])
def test_nest_children_in_pages(spark, hot):
    parents = spark.createDataFrame([(1, "p"), (2, "q"), (3, "r")], "id int, name string")
    children = spark.createDataFrame([(1, i, f"c{i}") for i in range(7)] + [(2, 0, None)],
                                     "id int, at int, body string")
    got = J.nest_children(parents, children, "id", ["at"], ["at", "body"], "comments", 3, hot)
    pages = {(r.id, r.page): [(c.at, c.body) for c in r.comments] for r in got.collect()}
    assert pages == {(1, 0): [(0, "c0"), (1, "c1"), (2, "c2")], (1, 1): [(3, "c3"), (4, "c4"), (5, "c5")],
                     (1, 2): [(6, "c6")], (2, 0): [(0, None)], (3, 0): []}
    assert {r.name for r in got.collect()} == {"p", "q", "r"}


def test_owner_scope_and_enrichment(spark, as_rows):
    tasks = spark.createDataFrame([(1, "t1"), (2, "t2"), (9, "t9")], "project_id int, task string")
    projects = spark.createDataFrame([(1, "u"), (2, None)], "project_id int, user_id string")
    assert as_rows(J.owner_scoped_join(tasks, projects, ["project_id"], "user_id")) == [(1, "t1", "u")]
    assert as_rows(J.enrich_by_key(tasks, projects, ["project_id"], ["user_id"])) == [
        (1, "t1", "u"), (2, "t2", None)]


def test_merge_accepts_expressions_before_it(spark):
    left = spark.range(3).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    assert J.match_merge([(left, ["x"])], ["k"]).count() == 3
