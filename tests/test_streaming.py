"""Streams give what their batch twins give."""

import random

from pyspark.sql import functions as F

from stepframe.operators.load import fold_changes, upsert_status
from stepframe.operators.sets import compare_verdict
from stepframe.session import scratch_path
from stepframe.operators.ordered import usage_limit_flag
from stepframe.streaming import (keyed_table, months_of, status_now, store_changes, stream_monthly_usage, stream_status_upsert,
                                 stream_usage_limit)
from stepframe.streaming import limits


def requests(spark):
    rnd = random.Random(5)
    data = [(i, rnd.randrange(4), f"2024-0{1 + i // 300}-{1 + (i % 300) // 12:02d} {rnd.randrange(24):02d}:00:00")
            for i in range(600)]
    df = spark.createDataFrame(data, "event_id bigint, user_id bigint, at string")
    return df.select("event_id", "user_id", F.to_timestamp_ntz("at").alias("ts"))


def run_usage(spark, source, schema, **options):
    out = scratch_path(spark, "days")
    stream = spark.readStream.schema(schema).options(**options).parquet(source)
    stream_monthly_usage(stream, out, scratch_path(spark, "state")).awaitTermination()
    return spark.read.schema("user_id bigint, day date, request_count bigint").parquet(out)


def test_usage_equals_batch_on_closed_days(spark):
    df = requests(spark).orderBy("ts")
    source = scratch_path(spark, "requests")
    repeated = df.unionByName(df.where("event_id % 10 = 0"))
    # One late repeat per tenth event, in the same file as the first one.
    repeated.coalesce(1).write.parquet(source)
    days = run_usage(spark, source, df.schema)
    last = df.agg(F.max("ts")).first()[0]
    closed = df.where(F.date_trunc("day", "ts") + F.expr("INTERVAL 1 DAY") <= F.lit(last) - F.expr("INTERVAL 1 HOUR"))
    want = closed.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("request_count"))
    assert compare_verdict(days, want).first().verdict == "PASS"
    months = months_of(days)
    assert months.agg(F.sum("request_count")).first()[0] == closed.count()
    assert {(r.year, r.month) for r in months.collect()} == {(2024, 1), (2024, 2)}


def test_usage_does_not_depend_on_the_session_time_zone(spark):
    df = requests(spark)
    source = scratch_path(spark, "requests")
    df.coalesce(1).write.parquet(source)
    plain = [tuple(r) for r in run_usage(spark, source, df.schema).orderBy("user_id", "day").collect()]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        moved = [tuple(r) for r in run_usage(spark, source, df.schema).orderBy("user_id", "day").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert moved == plain


def test_status_stream_equals_batch_and_survives_a_repeat(spark):
    rnd = random.Random(9)
    current = spark.range(20).select(
        "id", F.lit("pending").alias("status"), F.lit("").alias("code"), F.lit(1).alias("version"),
        F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")).alias("updated_at"))
    changes = spark.createDataFrame(
        [(rnd.randrange(25), i, rnd.choice(["", None, "converting", "converted"]),
          rnd.choice([None, "", f"v{i}"]), f"2024-02-01 00:{i // 60:02d}:{i % 60:02d}") for i in range(120)],
        "id bigint, seq bigint, status string, code string, at string")
    changes = changes.withColumn("at", F.to_timestamp_ntz("at"))
    source = scratch_path(spark, "changes")
    for n in range(3):
        # Separate files in time order: each becomes one batch.
        changes.where((F.col("seq") >= n * 40) & (F.col("seq") < n * 40 + 40)).coalesce(1).write.mode(
            "append").parquet(source)
    fields, path = ["status", "code"], scratch_path(spark, "batches")
    base = keyed_table(current, "status_base_of_test", "id", 4, scratch_path(spark, "base"))
    read = lambda base, since=0: status_now(base, path, "id", fields, since=since, buckets=4)
    store_changes(fold_changes(changes.limit(0), "id", ["seq"], fields, ["status"], "code", "at"), path, 0)
    assert compare_verdict(read(base), current, ["id"]).first().verdict == "PASS"
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream_status_upsert(stream, path, "id", fields, scratch_path(spark, "state"), ["seq"], ["status"], "code", "at").awaitTermination()
    want = upsert_status(current, changes, "id", ["seq"], fields, ["status"], "code", at="at")
    assert compare_verdict(read(base), want, ["id"]).first().verdict == "PASS"
    again = fold_changes(changes.where("seq >= 80"), "id", ["seq"], fields, ["status"], "code", "at")
    store_changes(again, path, 2)
    assert compare_verdict(read(base), want, ["id"]).first().verdict == "PASS"
    newer = keyed_table(read(base), "status_newer_base_of_test", "id", 4, scratch_path(spark, "newer"))
    assert compare_verdict(read(newer, since=3), want, ["id"]).first().verdict == "PASS"
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = read(base)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    join = plan[plan.index("SortMergeJoin"):]
    assert join.count("Exchange") == 1 and "batch" in join[join.index("Exchange"):], "only the changes are shuffled"


def run_limit(spark, source, schema, out, state, limit=7):
    stream = spark.readStream.schema(schema).parquet(source)
    stream_usage_limit(stream, limit, out, state).awaitTermination()
    return spark.read.parquet(out)


def test_limits_on_the_stream_equal_the_batch(spark):
    df = requests(spark)
    source, out, state = (scratch_path(spark, x) for x in ("requests", "decisions", "state"))
    # Three batches that follow each other in time, the first with a repeat and with requests of no user.
    first = df.where("event_id < 150").unionByName(df.where("event_id = 3")).unionByName(
        df.where("event_id between 20 and 40").withColumn("user_id", F.lit(None).cast("bigint")))
    parts = [first, df.where("event_id between 150 and 419"), df.where("event_id >= 420")]
    for part in parts:
        # Hours are drawn at random, so batches are cut by day.
        part.repartition(3).write.mode("append").parquet(source)
        got = run_limit(spark, source, df.schema, out, state)
    rows = [(r.user_id, r.event_id, r.decision == "accepted", r.used_after) for r in got.collect()]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    day = every.withColumn("month", F.month("ts"))
    want = usage_limit_flag(day.withColumn("batch", F.when(F.col("event_id") < 150, 0).when(F.col("event_id") < 420, 1).otherwise(2)),
                            ["user_id", "month"], ["batch", "ts"], 7, "event_id")
    some = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(rows, key=some) == sorted([(r.user_id, r.event_id, r.accepted, r.used_after) for r in want.collect()], key=some)


def test_late_requests_go_apart_and_months_are_let_go(spark):
    at = lambda text: f"TIMESTAMP_NTZ '{text}'"
    source, out, state = (scratch_path(spark, x) for x in ("requests", "decisions", "state"))

    def send(*rows):
        values = ", ".join(f"({e}, {u}, {at(t) if t else 'CAST(NULL AS TIMESTAMP_NTZ)'})" for e, u, t in rows)
        df = spark.sql(f"SELECT CAST(e AS bigint) AS event_id, CAST(u AS bigint) AS user_id, t AS ts FROM VALUES {values} AS v(e, u, t)")
        df.coalesce(1).write.mode("append").parquet(source)
        return {r.event_id: (r.decision, r.used_after) for r in run_limit(spark, source, df.schema, out, state, 2).collect()}

    send((1, 5, "2024-01-03 00:00:00"), (2, 5, "2024-01-02 00:00:00"), (3, 5, None))
    send((4, 5, "2024-01-01 00:00:00"), (5, 5, "2024-02-01 00:00:00"))
    send((6, 5, "2024-01-09 00:00:00"), (7, 5, "2024-03-01 00:00:00"))
    got = send((8, 5, "2024-01-10 00:00:00"), (9, 5, "2024-02-10 00:00:00"), (10, 6, "2023-05-05 00:00:00"))
    assert got == {1: ("accepted", 2), 2: ("accepted", 1), 3: ("late", None), 4: ("refused", 2), 5: ("accepted", 1),
                   6: ("refused", 2), 7: ("accepted", 1), 8: ("late", None), 9: ("accepted", 2), 10: ("accepted", 1)}
    assert spark.read.parquet(f"{out}/decision=late").count() == 2


def test_no_more_than_the_limit_is_held():
    import pandas as pd
    rng = random.Random(3)
    order = rng.sample(range(5000), 5000)
    pages = (pd.DataFrame([(1, i, i, 24289) for i in order[k:k + 100]]) for k in range(0, 5000, 100))
    used = {24289: 4, 24287: 9, 24288: 1}
    got = pd.concat(limits.decide(pages, used, 10))
    kept = got[got.decision == "accepted"]
    assert list(kept.event) == list(range(6)) and list(kept.used_after) == list(range(5, 11)) and len(got) == 5000
    assert used == {24288: 1, 24289: 10}
