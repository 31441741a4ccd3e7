"""Closures, digests of large tables, wide ranges, keys with blanks, safe replacement."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from stepframe import session
from stepframe.operators import joins as J
from stepframe.operators import load as D
from stepframe.operators import scripts as C
from stepframe.operators import sets as U


def test_upstream_tables_of_chains_diamonds_and_cycles(spark, as_rows):
    chain = [("p", f"c{i + 1}", f"c{i}") for i in range(12)]
    diamond = [("p", "top", "l"), ("p", "top", "r"), ("p", "l", "c0"), ("p", "r", "c0")]
    cycle = [("q", "a", "b"), ("q", "b", "c"), ("q", "c", "a"), ("q", "a", "out"), ("q", "c0", "c0"), (None, "x", "y")]
    rows = chain + diamond + cycle + diamond
    edges = spark.createDataFrame(rows, "project string, src string, dst string")
    roots = spark.createDataFrame([("p", "c0"), ("q", "out"), ("q", "nowhere"), ("p", "c0")], "project string, `table` string")
    got = as_rows(C.upstream_tables(edges, roots, ["project"]))
    con = duckdb.connect()
    con.execute("CREATE TABLE e (project VARCHAR, src VARCHAR, dst VARCHAR)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?)", rows)
    want = con.execute("""
        WITH RECURSIVE up AS (
          SELECT project, t, 0 AS depth FROM (VALUES ('p', 'c0'), ('q', 'out'), ('q', 'nowhere')) r(project, t)
          UNION SELECT up.project, e.src, depth + 1 FROM up JOIN e ON e.project = up.project AND e.dst = up.t WHERE depth < 30)
        SELECT project, t, min(depth)::INTEGER FROM up WHERE depth > 0 GROUP BY ALL""").fetchall()
    assert got == sorted(want) and len(got) == 18
    assert as_rows(C.final_tables(edges, ["project"])) == [(None, "y"), ("p", "c0"), ("q", "c0"), ("q", "out")]
    assert C.upstream_tables(edges.limit(0), roots, ["project"]).count() == 0
    everywhere = C.upstream_tables(edges, roots.select("table"), [])
    assert ("c12", 12) in as_rows(everywhere) and ("a", 1) in as_rows(everywhere)


def _versions(spark):
    rng = random.Random(8)
    a = [(i % 900, i, rng.choice([None, "", "x", "y"]), rng.choice([None, 0.0, 1.5])) for i in range(3000)] + [(None, 1, None, 2.0)] * 3
    b = [list(r) for r in a]
    for i in rng.sample(range(3000), 10):
        b[i][3] = 99.0
    schema = "k long, n long, t string, v double"
    return spark.createDataFrame(a, schema), spark.createDataFrame([tuple(r) for r in b[2:]] + [(7, -1, None, None)], schema)


@pytest.mark.parametrize("bits", [(12, 12), (1,), (2, 3, 4)])
def test_large_comparison_equals_the_plain_one(spark, as_rows, bits):
    a, b = _versions(spark)
    for keys in (["k", "n"], ["k"]):
        assert as_rows(U.large_dataset_compare(a, b, keys, bits=bits)) == as_rows(U.dataset_compare(a, b, keys))
    assert U.large_dataset_compare(a, a.orderBy(F.rand(1)), ["k"]).count() == 0


def test_large_comparison_reads_unequal_buckets_only(spark):
    a, b = _versions(spark)
    part_a, part_b = U.unequal_parts(a, b, ["k", "n"])
    assert part_a.count() == 12 and part_b.count() == 11
    plan = part_a._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    coarse, _ = U.unequal_parts(a, b, ["k", "n"], bits=(2, 12), many=1)
    assert coarse.count() > 500, "where many buckets differ the finer level is left out"


def test_digests_see_where_values_are_missing(spark):
    a = spark.createDataFrame([(1, None, "x")], "k int, s string, t string")
    b = spark.createDataFrame([(1, "x", None)], "k int, s string, t string")
    assert U.large_dataset_compare(a, b, ["k"]).count() == 2


def test_wide_ranges_meet_no_large_bucket(spark):
    rng = random.Random(2)
    df = spark.range(40_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 500.0 ELSE CAST(id % 1000 AS double) END AS v").union(
        spark.createDataFrame([(-1, None)], "id long, v double"))
    data = [(a := rng.uniform(0, 150), a + 800, i) for i in range(40)] + [(None, 3.0, 100), (990.0, None, 101), (5.0, 5.5, 102), (500.0, 500.0, 103)]
    ranges = spark.createDataFrame(data, "lo double, hi double, name long")
    keep = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "200"}
    old = {k: spark.conf.get(k) for k in keep}
    for k, v in keep.items():
        spark.conf.set(k, v)
    try:
        joined = J.range_join(df, ranges, "v", "lo", "hi")
        probe = joined.where("name < 40").groupBy("name", F.spark_partition_id().alias("p")).count().groupBy("p").agg(F.max("count").alias("n"))
        sizes = sorted(r.n for r in probe.collect())
        assert sizes[-1] <= 3 * sizes[len(sizes) // 2] and len(sizes) > 30
        got = joined.groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("id").alias("d"))
        plain = df.crossJoin(ranges.where("name <> 101")).where("(lo is null or v >= lo) and (v is null or v <= hi) and not (v is null and lo is not null)")
        want = {r.name: r["count"] for r in plain.groupBy("name").count().collect()}
        assert {r.name: r.n for r in got.collect()} == want and all(r.n == r.d for r in got.collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_keys_match_without_trailing_blanks(spark, as_rows):
    a = spark.createDataFrame([("A", 1), ("", 2), ("B ", 3), (" C", 4)], "k string, x int")
    b = spark.createDataFrame([("A  ", 10), (None, 20), ("B", 30), ("C", 40)], "k string, y int")
    merged = J.match_merge([(a, ["x"]), (b, ["y"])], ["k"])
    assert as_rows(merged) == [(None, 2, 20), (" C", 4, None), ("A", 1, 10), ("B", 3, 30), ("C", None, 40)]
    assert as_rows(J.not_in_target(a, b, ["k"])) == [(" C", 4)]
    assert as_rows(J.in_target(a, b, ["k"])) == [("", 2), ("A", 1), ("B ", 3)]
    assert as_rows(J.in_target(a, b, ["k"], ["y"])) == [("", 2, 20), ("A", 1, 10), ("B ", 3, 30)]
    assert as_rows(J.full_outer_merge(a, b, ["k"])) == [(None, 2, 20), (" C", 4, None), ("A  ", 1, 10), ("B", 3, 30), ("C", None, 40)]


def test_a_failed_switch_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    session.replace_table(spark.range(3), path)
    use = session._files

    class Refusing:
        """A store that does not rename new folders."""
        def __init__(self, fs):
            self.fs = fs

        def rename(self, a, b):
            return False if "-new-" in a.toString() else self.fs.rename(a, b)

        def __getattr__(self, name):
            return getattr(self.fs, name)

    monkeypatch.setattr(session, "_files", lambda s, p, f: use(s, p, lambda fs, at: f(Refusing(fs), at)))
    with pytest.raises(OSError):
        session.replace_table(spark.range(9), path)
    monkeypatch.setattr(session, "_files", use)
    assert spark.read.parquet(path).count() == 3
    session.replace_table(spark.range(9), path)
    assert spark.read.parquet(path).count() == 9 and [p.name for p in tmp_path.iterdir() if "-old-" in p.name] == []


def test_counters_keep_their_other_columns(spark, as_rows):
    counters = spark.createDataFrame([("gold", "u", 2), (None, "v", 1)], "plan string, user string, request_count long")
    events = spark.createDataFrame([("u",), ("u",), ("w",)], "user string")
    got = D.counter_upsert(counters, events, ["user"])
    assert got.columns == counters.columns
    assert as_rows(got) == [(None, "v", 1), (None, "w", 1), ("gold", "u", 4)]
