"""Order-dependent rows, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepframe.operators import ordered as W
from stepframe.operators import tracking as B
from workload.registry import query
from workload.summaries import projects, tasks


@query("having_remerge", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
WHERE l_quantity = (SELECT MAX(l_quantity) FROM lineitem)""")
def having_remerge(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return W.having_remerge(df, "l_quantity")


@query("group_remerge", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
       MAX(l_quantity) OVER (PARTITION BY l_suppkey) AS max_quantity,
       COUNT(*) OVER (PARTITION BY l_suppkey) AS n_rows
FROM lineitem""")
def group_remerge(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return W.group_remerge(df, ["l_suppkey"], {"max_quantity": F.max("l_quantity"),
                                               "n_rows": F.count(F.lit(1))})


@query("retain_counter", """
SELECT event_id, user_id, event_type,
       5 + SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)
           OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS counter
FROM events""")
def retain_counter(t):
    out = W.retain_counter(t.events.select("event_id", "user_id", "event_type", "ts"), ["user_id"],
                           ["ts", "event_id"], F.col("event_type") == "purchase", start=5)
    return out.drop("ts")


@query("retain_counter_all", """
SELECT o_orderkey, SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)
           OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS counter
FROM orders""")
def retain_counter_all(t):
    out = W.retain_counter(t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate"), [],
                           ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") == "F")
    return out.select("o_orderkey", "counter")


@query("first_last_row", """
SELECT o_orderkey, o_custkey,
       o_orderkey = MIN(o_orderkey) OVER (PARTITION BY o_custkey) AS is_first,
       o_orderkey = MAX(o_orderkey) OVER (PARTITION BY o_custkey) AS is_last,
       o_orderkey = MAX(o_orderkey) OVER () AS is_end
FROM orders""")
def first_last_row(t):
    df = W.first_last_flags(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey", ["o_custkey"])
    whole = W.first_last_flags(df.withColumnsRenamed({"is_first": "first", "is_last": "last"}), "o_orderkey")
    return whole.select("o_orderkey", "o_custkey", F.col("first").alias("is_first"),
                        F.col("last").alias("is_last"), F.col("is_last").alias("is_end"))


@query("global_max", """
SELECT CAST(coalesce(MAX(p_partkey), 0) AS BIGINT) AS max_key,
       CAST(coalesce(MAX(CASE WHEN p_size > 999 THEN p_partkey END), 0) AS BIGINT) AS empty_max
FROM part""")
def global_max(t):
    high = W.max_key(t.part, "p_partkey")
    none = W.max_key(t.part.where("p_size > 999"), "p_partkey")
    return t.part.agg(F.any_value(high).alias("max_key"), F.any_value(none).alias("empty_max"))


def known_parts(t):
    return t.part.where("p_size <= 25").selectExpr("p_partkey", "p_partkey + 1000 AS part_id",
                                                   "p_retailprice AS old_price")


@query("surrogate_key_new", """
WITH m AS (SELECT MAX(p_partkey) + 1000 AS last FROM part WHERE p_size <= 25)
SELECT p_partkey, p_name, p_partkey + 1000 AS part_id, p_retailprice AS old_price FROM part WHERE p_size <= 25
UNION ALL
SELECT p_partkey, p_name, last + ROW_NUMBER() OVER (ORDER BY p_partkey), NULL FROM part, m WHERE p_size > 25""")
def surrogate_key_new(t):
    return W.surrogate_keys(t.part.select("p_partkey", "p_name"), known_parts(t), ["p_partkey"], "part_id",
                            ["p_name"])


@query("surrogate_key_keep_all", """
WITH m AS (SELECT MAX(p_partkey) + 1000 AS last FROM part WHERE p_size <= 25)
SELECT l_partkey AS p_partkey, l_orderkey, p_partkey + 1000 AS part_id, p_retailprice AS old_price
FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) JOIN part ON p_partkey = l_partkey WHERE p_size <= 25
UNION ALL
SELECT l_partkey, l_orderkey, last + ROW_NUMBER() OVER (ORDER BY l_partkey, l_orderkey), NULL
FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem), m
WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)
UNION ALL
SELECT p_partkey, NULL, p_partkey + 1000, p_retailprice FROM part
WHERE p_size <= 25 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem)""")
def surrogate_key_keep_all(t):
    source = t.lineitem.selectExpr("l_partkey AS p_partkey", "l_orderkey").distinct()
    return W.surrogate_keys(source, known_parts(t), ["p_partkey"], "part_id", ["l_orderkey"], keep="all")


@query("surrogate_key_all", """
SELECT *, (SELECT MAX(p_partkey) + 1000 FROM part WHERE p_size <= 25)
          + ROW_NUMBER() OVER (ORDER BY o_orderdate, o_orderkey) AS id
FROM (SELECT o_orderkey, o_orderdate FROM orders)""")
def surrogate_key_all(t):
    target = known_parts(t).withColumnRenamed("part_id", "id")
    return W.surrogate_keys(t.orders.select("o_orderkey", "o_orderdate"), target, ["o_orderkey"], "id",
                            ["o_orderdate", "o_orderkey"], mode="all")


@query("surrogate_key_start", """
SELECT c_custkey, 499 + ROW_NUMBER() OVER (ORDER BY c_custkey) AS from_value,
       (SELECT MAX(o_orderkey) FROM orders) + ROW_NUMBER() OVER (ORDER BY c_custkey) AS from_lookup
FROM customer""")
def surrogate_key_start(t):
    lookup = t.orders.agg(F.max("o_orderkey").alias("last_key"))
    first = W.surrogate_keys(t.customer.select("c_custkey"), None, ["c_custkey"], "from_value",
                             ["c_custkey"], mode="all", start_from=500)
    return W.surrogate_keys(first, None, ["c_custkey"], "from_lookup", ["c_custkey"], mode="all",
                            start_from=lookup)


@query("usage_limit_flag", """
SELECT event_id, user_id, rn <= 40 AS accepted, CAST(least(rn, 40) AS INTEGER) AS used_after
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, year(ts), month(ts) ORDER BY ts, event_id) AS rn
      FROM events)""")
def usage_limit_flag(t):
    requests = t.events.select("event_id", "user_id", "ts", F.year("ts").alias("year"),
                               F.month("ts").alias("month"))
    flagged = W.usage_limit_flag(requests, ["user_id", "year", "month"], ["ts", "event_id"], 40, "event_id")
    return flagged.select("event_id", "user_id", "accepted", "used_after")


@query("top_n_recent", """
SELECT user_id, project_id, project_name, l_linenumber, l_partkey, l_suppkey, task_status, updated_at,
       CAST(rank AS INTEGER) AS rank
FROM (SELECT o_custkey AS user_id, o_orderkey AS project_id, o_orderpriority AS project_name, l_linenumber,
             l_partkey, l_suppkey, CASE l_returnflag WHEN 'N' THEN 'pending' WHEN 'R' THEN 'converting'
                                   ELSE 'converted' END AS task_status, l_shipdate AS updated_at,
             ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber,
                                l_partkey, l_suppkey, l_extendedprice) AS rank
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey) WHERE rank <= 10""")
def top_n_recent(t):
    recent = B.recent_activity(
        tasks(t).withColumnRenamed("status", "task_status"),
        projects(t).select("user_id", "project_id", "project_name"),
        ["project_id", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return recent.select("user_id", "project_id", "project_name", "l_linenumber", "l_partkey", "l_suppkey",
                         "task_status", "updated_at", "rank")


CHANGE_ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query("task_versions", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, 1 + ROW_NUMBER() OVER (
  PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS version
FROM lineitem""")
def task_versions(t):
    changes = t.lineitem.select("l_orderkey", *CHANGE_ORDER)
    return W.versions(changes, ["l_orderkey"], CHANGE_ORDER).drop("l_shipdate")


@query("latest_version", """
SELECT l_orderkey, version, l_partkey, l_shipdate FROM (
  SELECT *, 1 + ROW_NUMBER() OVER w AS version, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY
         l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS last
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY
         l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) WHERE last = 1""")
def latest_version(t):
    return W.latest_version(t.lineitem, ["l_orderkey"], CHANGE_ORDER, ["l_partkey", "l_shipdate"])


@query("sort_by_keys", "SELECT * FROM part ORDER BY p_brand, p_name, p_partkey")
def sort_by_keys(t):
    return t.part.orderBy("p_brand", "p_name", "p_partkey")


@query("filtered_sort", """
SELECT * FROM part WHERE p_type = 'PROMO' AND p_size > 10
ORDER BY p_retailprice, p_size DESC, p_partkey""")
def filtered_sort(t):
    kept = t.part.where("p_type = 'PROMO' AND p_size > 10")
    return kept.orderBy(F.col("p_retailprice").asc(), F.col("p_size").desc(), "p_partkey")


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10)


@query("first_match", """
SELECT user_id, event_id, event_type, value FROM events
QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""")
def first_match(t):
    first = W.first_match(t.events.select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"],
                          ["ts", "event_id"])
    return first.drop("ts")


@query("ordered_listing", """
SELECT o_custkey, o_orderkey, o_orderdate FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey""")
def ordered_listing(t):
    return t.orders.select("o_custkey", "o_orderkey", "o_orderdate").orderBy(
        "o_custkey", F.col("o_orderdate").desc(), "o_orderkey")
