"""Joins with a key that holds a third of the rows are split by AQE, so no task gets the whole key."""

import pytest
from pyspark.sql import functions as F

from stepframe.operators import joins as J
from stepframe.operators import ordered as W

SETTINGS = {
    "spark.sql.shuffle.partitions": "32",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
}


@pytest.fixture()
def small_limits(spark):
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k in SETTINGS:
        spark.conf.unset(k)


def skewed(spark, n=200_000):
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.xxhash64("id") % 5000).cast("bigint")
    return spark.range(n, numPartitions=8).select(key.alias("k"), F.col("id").alias("i"),
                                                  F.sha1(F.col("id").cast("string")).alias("text"))


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["group_remerge", "enrich_by_key", "in_target", "first_last_flags", "range_join"])
def test_large_key_is_split(spark, small_limits, name):
    df = skewed(spark)
    lookup = df.groupBy("k").agg(F.min("i").alias("label"))
    made = {
        "group_remerge": lambda: W.group_remerge(df, ["k"], {"top": F.max("i")}),
        "enrich_by_key": lambda: J.enrich_by_key(df, spark.range(-5000, 5000).selectExpr("id AS k", "id AS label"),
                                                 ["k"], ["label"]),
        "in_target": lambda: J.in_target(df, spark.range(-5000, 5000).selectExpr("id AS k", "id AS label"),
                                         ["k"], ["label"]),
        "first_last_flags": lambda: W.first_last_flags(df, "i", ["k"]),
        "range_join": lambda: J.range_join(df, lookup.selectExpr("k AS lo", "k + 0.5 AS hi").repartition(4),
                                           "k", "lo", "hi"),
    }[name]()
    assert "skew=true" in final_plan(made)
