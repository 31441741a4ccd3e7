"""Profiles of loads, merged."""

import random

from pyspark.sql import functions as F

from stepframe.operators import profiles as P
from stepframe.session import materialize


def _rows(spark, n=20_000):
    rng = random.Random(6)
    data = [(i, rng.choice([None, "", "x", "y"]), rng.choice([None, rng.gauss(50, 9), 7.0]), rng.randrange(3000)) for i in range(n)]
    df = spark.createDataFrame(data, "id long, s string, v double, k int")
    return data, df.withColumn("d", F.date_add(F.lit("2020-01-01").cast("date"), F.col("k"))).withColumn(
        "t", F.timestamp_seconds("id").cast("timestamp_ntz"))


def test_merged_loads_equal_one_profile(spark, tmp_path):
    data, df = _rows(spark)
    path = str(tmp_path / "profiles")
    for load in (0, 1, 2, 1):
        P.store_profile(P.load_profile(df.where(F.col("id") % 3 == load)), path, f"l{load}")
    P.store_profile(P.load_profile(df.limit(0)), path, "empty")
    merged = {r.column_name: r for r in P.read_profile(P.merge_profiles(P.stored_profiles(spark, path))).collect()}
    whole = {r.column_name: r for r in P.read_profile(P.load_profile(df)).collect()}
    assert set(merged) == {"id", "s", "v", "k", "d", "t"}
    for name, r in merged.items():
        w = whole[name]
        assert (r.type, r.n_rows, r.n_missing, r.low, r.high, r.low_text, r.high_text, r.n_distinct) == (
            w.type, w.n_rows, w.n_missing, w.low, w.high, w.low_text, w.high_text, w.n_distinct), name
    exact = df.agg(*[F.count_distinct(c).alias(c) for c in merged]).first()
    assert all(abs(r.n_distinct - exact[c]) <= r.distinct_error * exact[c] for c, r in merged.items())
    values = sorted(v for _, _, v, _ in data if v is not None)
    for rank, x in zip((0.05, 0.25, 0.5, 0.75, 0.95), merged["v"].at_ranks):
        below, upto = sum(v < x for v in values) / len(values), sum(v <= x for v in values) / len(values)
        assert below - P.RANK_ERROR <= rank <= upto + P.RANK_ERROR
    assert merged["s"].at_ranks is None and (merged["s"].low_text, merged["s"].high_text) == ("", "y")


def test_profiles_of_nothing(spark):
    df = spark.createDataFrame([(None, None, float("nan"))], "a int, b string, c double")
    got = {r.column_name: r for r in P.read_profile(P.load_profile(df)).collect()}
    assert (got["a"].n_missing, got["a"].n_distinct, got["a"].mean, got["a"].at_ranks) == (1, 0, None, None)
    assert (got["c"].n_missing, got["c"].low, got["c"].at_ranks) == (0, None, None)
    assert all(r.n_rows == 0 for r in P.read_profile(P.load_profile(df.limit(0))).collect())


def test_drawn_values_are_spread_as_the_source(spark):
    _, df = _rows(spark)
    profile = materialize(P.load_profile(df), "profile")
    made = P.draw_from_profile(spark.range(8000), "id", profile, ["v", "k", "d", "t"], seed=3)
    assert made.dtypes[1:] == [("v", "double"), ("k", "int"), ("d", "date"), ("t", "timestamp_ntz")]
    q = lambda d: d.select(F.percentile("v", [0.1, 0.4, 0.5, 0.9])).first()[0]
    assert all(abs(a - b) < 1.5 for a, b in zip(q(made), q(df)))
    assert abs(made.where("v = 7.0").count() / 8000 - df.where("v = 7.0").count() / 20_000) < 0.03
    assert abs(made.where("v IS NULL").count() / 8000 - df.where("v IS NULL").count() / 20_000) < 0.03
    low, high = made.agg(F.min("d"), F.max("d")).first()
    assert (low, high) >= tuple(df.agg(F.min("d"), F.max("d")).first()[:1]) and made.where("k < 0 OR k > 2999").count() == 0
    again = P.draw_from_profile(spark.range(8000).repartition(3), "id", profile, ["v", "k", "d", "t"], seed=3)
    assert made.exceptAll(again).count() == 0
