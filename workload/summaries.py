"""Aggregation and job-tracking boards."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepframe import functions as fn
from stepframe.operators import summary as A
from stepframe.operators import tracking as B
from stepframe.operators import profiles as P
from stepframe.session import scratch_path
from workload.registry import query

RATED_SQL = """(SELECT *, CASE WHEN price IS NULL OR price < 20000 THEN 5
       WHEN price > 20000 AND price < 40000 THEN 4 WHEN price > 40000 AND price < 60000 THEN 3
       WHEN price > 60000 AND price < 80000 THEN 2 WHEN price > 80000 THEN 1 END AS RATING
  FROM (SELECT l_quantity, l_returnflag, CASE WHEN l_linenumber = 7 THEN 20000 WHEN l_quantity <> 13
                                  THEN l_extendedprice END AS price FROM lineitem))"""


def rated(t):
    """Lineitems rated by price; line 7 sits on a bound (no band), quantity 13 has no price."""
    price = F.when(F.col("l_linenumber") == 7, F.lit(20000.0)).when(
        F.col("l_quantity") != 13, F.col("l_extendedprice"))
    df = t.lineitem.select("l_quantity", "l_returnflag", price.alias("price"))
    return df.withColumn("RATING", fn.band_ladder("price", [20000, 40000, 60000, 80000], [5, 4, 3, 2, 1]))


@query("class_means", f"""
SELECT RATING, CASE WHEN GROUPING(RATING) = 1 THEN 0 ELSE 1 END AS _TYPE_, COUNT(*) AS _FREQ_,
       round(AVG(price), 4) AS Mean_price
FROM {RATED_SQL} WHERE RATING IS NOT NULL GROUP BY GROUPING SETS ((RATING), ())""")
def class_means(t):
    out = A.class_means(rated(t), ["RATING"], {"Mean_price": ("mean", "price")})
    return out.withColumn("Mean_price", F.round("Mean_price", 4))


@query("class_means_multi", """
SELECT l_returnflag, l_linestatus, line, 7 - GROUPING(l_returnflag, l_linestatus, line) AS _TYPE_,
       COUNT(*) AS _FREQ_, round(AVG(l_quantity), 4) AS mean_quantity, round(MAX(l_tax), 4) AS max_tax
FROM (SELECT *, nullif(l_linenumber, 7) AS line FROM lineitem) WHERE line IS NOT NULL
GROUP BY CUBE (l_returnflag, l_linestatus, line)""")
def class_means_multi(t):
    df = t.lineitem.withColumn("line", F.nullif("l_linenumber", F.lit(7)))
    out = A.class_means(df, ["l_returnflag", "l_linestatus", "line"], {
        "mean_quantity": ("mean", "l_quantity"), "max_tax": ("max", "l_tax")})
    return out.withColumns({"_TYPE_": F.col("_TYPE_").cast("bigint"),
                            "mean_quantity": F.round("mean_quantity", 4), "max_tax": F.round("max_tax", 4)})


@query("class_means_nway", """
SELECT l_returnflag, l_linestatus, 3 AS _TYPE_, COUNT(*) AS _FREQ_, round(AVG(l_quantity), 4) AS mean_quantity
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def class_means_nway(t):
    return A.class_means(t.lineitem, ["l_returnflag", "l_linestatus"],
                         {"mean_quantity": F.round(F.avg("l_quantity"), 4)}, nway=True)


@query("overall_means", """
SELECT round(AVG(l_extendedprice), 4) AS avg_price, round(AVG(l_extendedprice * 1.2), 4) AS avg_price_usd,
       round(AVG(nullif(l_quantity, 13)), 4) AS avg_quantity
FROM lineitem WHERE l_returnflag = 'A'""")
def overall_means(t):
    df = t.lineitem.where("l_returnflag = 'A'")
    return A.overall_means(df, {
        "avg_price": F.round(F.avg("l_extendedprice"), 4),
        "avg_price_usd": F.round(F.avg(F.col("l_extendedprice") * 1.2), 4),
        "avg_quantity": F.round(F.avg(F.nullif("l_quantity", F.lit(13))), 4)})


@query("freq_oneway", f"""
SELECT RATING, COUNT(*) AS COUNT,
       CASE WHEN RATING IS NOT NULL THEN round(100.0 * COUNT(*) / SUM(COUNT(RATING)) OVER (), 4) END AS PERCENT
FROM {RATED_SQL} GROUP BY RATING""")
def freq_oneway(t):
    return A.freq_oneway(rated(t), "RATING").withColumn("PERCENT", F.round("PERCENT", 4))


@query("count_by_status", "SELECT o_orderstatus AS status, COUNT(*) AS n FROM orders GROUP BY o_orderstatus")
def count_by_status(t):
    return A.count_by(t.orders.withColumnRenamed("o_orderstatus", "status"), ["status"])


@query("distinct_rows", "SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem")
def distinct_rows(t):
    return t.lineitem.select("l_partkey", "l_suppkey", "l_returnflag").distinct()


def projects(t):
    return t.orders.selectExpr(
        "o_custkey AS user_id", "o_orderkey AS project_id", "o_orderpriority AS project_name",
        "CASE o_orderstatus WHEN 'O' THEN 'ready' WHEN 'P' THEN 'converting' ELSE 'completed' END AS status",
        "o_orderdate AS project_updated")


def tasks(t):
    return t.lineitem.selectExpr(
        "l_orderkey AS project_id", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate AS updated_at",
        "CASE l_returnflag WHEN 'N' THEN 'pending' WHEN 'R' THEN 'converting' ELSE 'converted' END AS status",
        "l_extendedprice")


@query("status_dashboard", """
WITH p AS (SELECT o_custkey, COUNT(*) AS total_projects,
                  COUNT(*) FILTER (o_orderstatus IN ('O', 'P')) AS active_projects,
                  COUNT(*) FILTER (o_orderstatus = 'F') AS completed_projects FROM orders GROUP BY o_custkey),
     k AS (SELECT o_custkey, COUNT(*) AS total_tasks, COUNT(*) FILTER (l_returnflag = 'N') AS pending_tasks,
                  COUNT(*) FILTER (l_returnflag = 'A') AS converted_tasks
           FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey)
SELECT c_custkey AS user_id, coalesce(total_projects, 0) AS total_projects,
       coalesce(active_projects, 0) AS active_projects, coalesce(completed_projects, 0) AS completed_projects,
       coalesce(total_tasks, 0) AS total_tasks, coalesce(pending_tasks, 0) AS pending_tasks,
       coalesce(converted_tasks, 0) AS converted_tasks,
       coalesce(total_tasks - pending_tasks - converted_tasks, 0) AS failed_tasks
FROM customer LEFT JOIN p ON p.o_custkey = c_custkey LEFT JOIN k ON k.o_custkey = c_custkey""")
def status_dashboard(t):
    owners = t.customer.selectExpr("c_custkey AS user_id")
    return B.status_dashboard(owners, projects(t), tasks(t).select("project_id", "status"))


@query("progress_percent", """
SELECT l_orderkey AS project_id, COUNT(*) AS total_tasks, COUNT(*) FILTER (l_returnflag <> 'N') AS processed_tasks,
       CAST(floor(100.0 * COUNT(*) FILTER (l_returnflag <> 'N') / COUNT(*)) AS INTEGER) AS progress
FROM lineitem GROUP BY l_orderkey""")
def progress_percent(t):
    return A.progress_percent(tasks(t), ["project_id"], F.col("status") != "pending")


@query("monthly_usage", """
SELECT user_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, COUNT(*) AS request_count,
       coalesce(MAX(lim), 1000) AS monthly_limit, greatest(0, coalesce(MAX(lim), 1000) - COUNT(*)) AS remaining
FROM events LEFT JOIN (SELECT c_custkey, CAST(c_nationkey * 5 AS BIGINT) AS lim FROM customer
                       WHERE c_mktsegment <> 'BUILDING') ON c_custkey = user_id
GROUP BY user_id, year(ts), month(ts)""")
def monthly_usage(t):
    limits = t.customer.where("c_mktsegment <> 'BUILDING'").selectExpr(
        "c_custkey AS user_id", "c_nationkey * 5 AS monthly_request_limit")
    return B.monthly_usage(t.events, limits)


@query("conversion_time_stats", """
SELECT o_custkey AS user_id, COUNT(completed) AS files_converted,
       CAST(coalesce(SUM(n_parts), 0) AS BIGINT) AS dependencies_mapped,
       round(AVG(epoch(completed) - epoch(o_orderdate)), 4) AS avg_conversion_seconds
FROM orders LEFT JOIN (SELECT l_orderkey, MAX(l_shipdate) AS completed, COUNT(DISTINCT l_partkey) AS n_parts
                       FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
GROUP BY o_custkey""")
def conversion_time_stats(t):
    done = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max("l_shipdate").alias("completed"), F.count_distinct("l_partkey").alias("n_parts"))
    work = t.orders.join(done, "o_orderkey", "left").withColumnRenamed("o_custkey", "user_id")
    out = A.conversion_time_stats(work, ["user_id"], "o_orderdate", "completed", {
        "dependencies_mapped": F.coalesce(F.sum("n_parts"), F.lit(0))})
    return out.withColumn("avg_conversion_seconds", F.round("avg_conversion_seconds", 4))


@query("return_code_rollup", """
SELECT user_id AS job, event_type AS step, CASE WHEN GROUPING(event_type) = 1 THEN 'job' ELSE 'step' END AS level,
       MAX(CAST(floor(value) AS BIGINT)) AS rc
FROM events GROUP BY GROUPING SETS ((user_id, event_type), (user_id))""")
def return_code_rollup(t):
    codes = t.events.select(F.col("user_id").alias("job"), F.col("event_type").alias("step"),
                            F.floor("value").alias("code"))
    return A.return_code_rollup(codes, "job", "step", "code")


def _profile_sql(table: str, columns: list[tuple[str, str, bool]]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{name}' AS column_name, COUNT(*) AS n_rows, COUNT(*) - COUNT({e}) AS n_missing, "
        f"COUNT(DISTINCT {e}) AS n_distinct, CAST(MIN({e}) AS VARCHAR) AS lowest, "
        f"CAST(MAX({e}) AS VARCHAR) AS highest, "
        + (f"round(AVG({e}), 4)" if number else "CAST(NULL AS DOUBLE)") + f" AS mean FROM {table}"
        for name, e, number in columns)


PROFILE_SQL = _profile_sql("orders", [
    ("o_orderkey", "o_orderkey", True), ("o_custkey", "o_custkey", True),
    ("o_orderstatus", "nullif(o_orderstatus, 'P')", False), ("o_totalprice", "o_totalprice", True),
    ("o_orderdate", "o_orderdate", False), ("o_orderpriority", "o_orderpriority", False)])


def order_profile(t):
    df = t.orders.withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    return A.column_profile(df, exact=True).withColumn("mean", F.round("mean", 4))


@query("column_profile", PROFILE_SQL)
def column_profile(t):
    return order_profile(t)


@query("file_count", """
SELECT source AS project_id, COUNT(*) FILTER (n_chars >= 200) AS file_count FROM documents GROUP BY source""")
def file_count(t):
    status = F.when(F.col("n_chars") >= 200, "accepted").otherwise("skipped_blank")
    return B.file_count(t.documents.select(F.col("source").alias("project_id"), status.alias("status")))


def _merged_sql(table: str, columns: list[tuple[str, str, bool]]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{name}' AS column_name, COUNT(*) AS n_rows, COUNT(*) - COUNT({name}) AS n_missing, "
        + (f"CAST(MIN({e}) AS DOUBLE) AS low, CAST(MAX({e}) AS DOUBLE) AS high, CAST(NULL AS VARCHAR) AS low_text, "
           if number else f"CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high, MIN({e}) AS low_text, ")
        + f"TRUE AS distinct_within, TRUE AS median_within FROM {table}" for name, e, number in columns)


@query("merged_profile", _merged_sql("orders", [
    ("o_orderkey", "o_orderkey", True), ("o_custkey", "o_custkey", True), ("o_totalprice", "o_totalprice", True),
    ("o_orderdate", "CAST(o_orderdate AS DATE) - DATE '1970-01-01'", True), ("o_orderpriority", "o_orderpriority", False)]))
def merged_profile(t):
    """Three loads, profiled and stored one by one, read as one profile; estimates are held against exact counts."""
    names, path = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"], scratch_path(t.spark, "profiles")
    orders = t.orders.select(*names).withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    for load in range(3):
        P.store_profile(P.load_profile(orders.where(F.col("o_orderkey") % 3 == load)), path, f"load{load}")
    merged = P.read_profile(P.merge_profiles(P.stored_profiles(t.spark, path)), [0.5])
    # Exact figures, one row per column: distinct values and the shares of rows below and up to the estimated median.
    medians = merged.select(F.map_from_entries(F.collect_list(F.struct("column_name", F.get("at_ranks", F.lit(0)))))).scalar()
    at = orders.withColumn("_m", medians)
    number = {c: F.unix_date(c) if c == "o_orderdate" else F.col(c) for c in names[:-1]}
    exact = at.agg(*[F.struct(
        F.lit(c).alias("column_name"), F.count_distinct(c).alias("n"),
        *([F.avg((number[c] < F.col("_m")[c]).cast("int")).alias("below"), F.avg((number[c] <= F.col("_m")[c]).cast("int")).alias("upto")]
          if c in number else [F.lit(0.0).alias("below"), F.lit(1.0).alias("upto")])).alias(c) for c in names])
    exact = exact.select(F.inline(F.array(*names)))
    off = F.abs(F.col("n_distinct") - F.col("n")) <= F.col("distinct_error") * F.col("n")
    middle = (F.col("below") - P.RANK_ERROR <= 0.5) & (F.col("upto") + P.RANK_ERROR >= 0.5)
    return merged.join(exact, "column_name").select("column_name", "n_rows", "n_missing", "low", "high", "low_text",
                                                    off.alias("distinct_within"), middle.alias("median_within"))
