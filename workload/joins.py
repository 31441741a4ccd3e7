"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepframe import functions as fn
from stepframe.operators import joins as J
from stepframe.operators import sets as U
from workload.registry import query


@query("inner_equi_join", """
WITH b AS (SELECT c_nationkey, c_mktsegment, AVG(c_acctbal) AS mpg, COUNT(*) AS n
           FROM customer GROUP BY c_nationkey, c_mktsegment)
SELECT a.c_custkey, a.c_nationkey, a.c_mktsegment, round(b.mpg, 4) AS mpg
FROM customer a JOIN b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment
WHERE b.n > 10""")
def inner_equi_join(t):
    keys = ["c_nationkey", "c_mktsegment"]
    b = t.customer.groupBy(*keys).agg(F.round(F.avg("c_acctbal"), 4).alias("mpg"), F.count(F.lit(1)).alias("n"))
    a = t.customer.select("c_custkey", *keys)
    return a.join(b.where("n > 10").drop("n"), keys)


STAR_KEYS = ["l_returnflag", "l_linestatus", "p_brand", "p_type", "s_name", "l_partkey", "l_suppkey",
             "l_quantity", "l_linenumber"]
STAR_SQL = """
SELECT DISTINCT t1.l_returnflag, t1.l_linestatus, t2.p_brand, t2.p_type, t3.s_name, t1.l_partkey,
       t1.l_suppkey, t1.l_quantity, t1.l_linenumber, t1.l_extendedprice AS price_lb
FROM lineitem t1, part t2, supplier t3
WHERE (t1.l_partkey = t2.p_partkey AND t1.l_suppkey = t3.s_suppkey)
  AND (t1.l_returnflag = 'R' AND t2.p_type IN ('PROMO', 'LARGE', 'SMALL')
       AND t3.s_nationkey IN (0, 1, 2, 3, 5, 8, 13, 21) AND t2.p_name NOT IN (''))"""


def star(t):
    fact = t.lineitem.where("l_returnflag = 'R'").select(
        "l_returnflag", "l_linestatus", "l_partkey", "l_suppkey", "l_quantity", "l_linenumber",
        F.col("l_extendedprice").alias("price_lb"))
    parts = t.part.where(F.col("p_type").isin("PROMO", "LARGE", "SMALL") & fn.not_blank("p_name"))
    parts = parts.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    suppliers = t.supplier.where(F.col("s_nationkey").isin(0, 1, 2, 3, 5, 8, 13, 21))
    suppliers = suppliers.select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    # No hint: Spark broadcasts a lookup while it is below the size limit and sorts it beyond.
    joined = fact.join(parts, "l_partkey").join(suppliers, "l_suppkey")
    return joined.select(*STAR_KEYS, "price_lb").distinct()


@query("lookup_star_join", STAR_SQL)
def lookup_star_join(t):
    return star(t)


@query("wide_order_by", STAR_SQL + "\nORDER BY " + ", ".join(STAR_KEYS) + ", price_lb")
def wide_order_by(t):
    return star(t).orderBy(*STAR_KEYS, "price_lb")


@query("range_join", """
WITH bands AS (SELECT floor(p_size / 10) AS band, nullif(MIN(p_size), 1) AS lo, MAX(p_size) + 5 AS hi
               FROM part GROUP BY floor(p_size / 10))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, q, CAST(band AS BIGINT) AS band
FROM (SELECT *, nullif(l_quantity, 13) AS q FROM lineitem), bands
WHERE (lo IS NULL OR coalesce(q >= lo, false)) AND (q IS NULL OR q <= hi)""")
def range_join(t):
    band = F.floor(F.col("p_size") / 10).alias("band")
    bands = t.part.groupBy(band).agg(F.nullif(F.min("p_size"), F.lit(1)).alias("lo"),
                                     (F.max("p_size") + 5).alias("hi"))
    facts = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                              F.nullif("l_quantity", F.lit(13)).alias("q"))
    return J.range_join(facts, bands, "q", "lo", "hi").drop("lo", "hi")


@query("match_merge", """
WITH a AS (SELECT o_custkey AS k, o_orderkey, o_totalprice AS amt,
                  ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders),
     b AS (SELECT user_id AS k, event_id, value AS amt,
                  ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
     c AS (SELECT p_partkey AS k, p_name, 1 AS rn FROM part),
     pos AS (SELECT k, rn FROM a UNION SELECT k, rn FROM b UNION SELECT k, rn FROM c),
     j AS (SELECT pos.k, pos.rn, a.o_orderkey, b.event_id, c.p_name, coalesce(b.amt, a.amt) AS amt
           FROM pos LEFT JOIN a USING (k, rn) LEFT JOIN b USING (k, rn) LEFT JOIN c USING (k, rn))
SELECT k, rn, last_value(o_orderkey IGNORE NULLS) OVER w AS o_orderkey,
       last_value(event_id IGNORE NULLS) OVER w AS event_id,
       last_value(p_name IGNORE NULLS) OVER w AS p_name,
       last_value(amt IGNORE NULLS) OVER w AS amt,
       MAX(o_orderkey) OVER (PARTITION BY k) IS NOT NULL AS in_orders,
       MAX(event_id) OVER (PARTITION BY k) IS NOT NULL AS in_events,
       MAX(p_name) OVER (PARTITION BY k) IS NOT NULL AS in_parts
FROM j
WINDOW w AS (PARTITION BY k ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def match_merge(t):
    a = t.orders.selectExpr("o_custkey AS k", "o_orderkey", "o_totalprice AS amt")
    b = t.events.selectExpr("user_id AS k", "ts", "event_id", "value AS amt")
    c = t.part.selectExpr("p_partkey AS k", "p_name")
    merged = J.match_merge([(a, ["o_orderkey"]), (b, ["ts", "event_id"]), (c, ["p_name"])], ["k"],
                           ["in_orders", "in_events", "in_parts"], position="rn")
    return merged.drop("ts")


@query("merge_with_presence", """
SELECT o_custkey AS k, o_orderkey, o_totalprice AS amt, c_name, c_custkey IS NOT NULL AS in_target
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 2000) ON c_custkey = o_custkey""")
def merge_with_presence(t):
    target = t.customer.where("c_acctbal > 2000").selectExpr("c_custkey AS k", "c_name", "c_acctbal AS amt")
    source = t.orders.selectExpr("o_custkey AS k", "o_orderkey", "o_totalprice AS amt")
    return J.merge_with_presence((target, ["k"]), (source, ["o_orderkey"]), ["k"]).select(
        "k", "o_orderkey", "amt", "c_name", "in_target")


@query("not_in_target", """
SELECT c_custkey, c_name FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def not_in_target(t):
    target = t.orders.where("o_totalprice > 400000").selectExpr("o_custkey AS c_custkey")
    return J.not_in_target(t.customer, target, ["c_custkey"]).select("c_custkey", "c_name")


@query("in_target", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_partkey + 1000 AS part_id
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 25""")
def in_target(t):
    target = t.part.where("p_size <= 25").selectExpr("p_partkey AS l_partkey", "p_partkey + 1000 AS part_id")
    source = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return J.in_target(source, target, ["l_partkey"], ["part_id"])


@query("owner_scoped_join", """
SELECT o_custkey AS user_id, o_orderkey AS project_id, l_linenumber, l_partkey, l_suppkey
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def owner_scoped_join(t):
    tasks = t.lineitem.selectExpr("l_orderkey AS project_id", "l_linenumber", "l_partkey", "l_suppkey")
    projects = t.orders.selectExpr("o_orderkey AS project_id", "o_custkey AS user_id")
    return J.owner_scoped_join(tasks, projects, ["project_id"], "user_id")


@query("nest_children", """
SELECT doc_id, CAST(coalesce((rn - 1) // 2, 0) AS BIGINT) AS page, CAST(COUNT(rn) AS INTEGER) AS n_comments,
       coalesce(string_agg(turn || ':' || role || ':' || body, chr(10) ORDER BY rn), '') AS comments
FROM documents LEFT JOIN (SELECT conv_id, turn, role, text AS body,
                                 ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
                          FROM conversations) ON conv_id = doc_id
GROUP BY doc_id, page""")
def nest_children(t):
    children = t.conversations.withColumnRenamed("conv_id", "doc_id")
    nested = J.nest_children(t.documents.select("doc_id"), children, "doc_id", ["turn"],
                             ["turn", "role", "text"], "comments", page_size=2)
    flat = F.transform("comments", lambda c: F.concat_ws(":", c["turn"].cast("string"), c["role"], c["text"]))
    return nested.select("doc_id", "page", F.size("comments").alias("n_comments"),
                         F.array_join(flat, "\n").alias("comments"))


@query("enrich_by_key", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, s_name, s_nationkey
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 0""")
def enrich_by_key(t):
    suppliers = t.supplier.where("s_acctbal > 0").withColumnRenamed("s_suppkey", "l_suppkey")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return J.enrich_by_key(rows, suppliers, ["l_suppkey"], ["s_name", "s_nationkey"])


@query("full_outer_merge", """
SELECT coalesce(p_partkey, c_custkey) AS k, c_name, p_name,
       CASE WHEN p_partkey IS NOT NULL THEN nullif(p_retailprice, 900.1) ELSE c_acctbal END AS amt
FROM customer FULL JOIN part ON c_custkey = p_partkey""")
def full_outer_merge(t):
    left = t.customer.selectExpr("c_custkey AS k", "c_name", "c_acctbal AS amt")
    right = t.part.selectExpr("p_partkey AS k", "p_name", "nullif(p_retailprice, 900.1D) AS amt")
    return J.full_outer_merge(left, right, ["k"])


@query("set_concat", """
SELECT c_name AS name, c_nationkey AS nationkey, c_mktsegment AS segment, 1 AS source FROM customer
UNION ALL SELECT s_name, s_nationkey, NULL, 2 FROM supplier
UNION ALL SELECT n_name, NULL, NULL, 3 FROM nation""")
def set_concat(t):
    return U.set_concat([
        t.customer.selectExpr("c_name AS name", "c_nationkey AS nationkey", "c_mktsegment AS segment"),
        t.supplier.selectExpr("s_nationkey AS nationkey", "s_name AS name"),
        t.nation.selectExpr("n_name AS name")], "source")


@query("union_distinct", """
SELECT DISTINCT trim(p_brand) AS make, trim(p_type) AS model FROM part
UNION SELECT DISTINCT trim(c_mktsegment), trim(c_mktsegment) FROM customer
UNION SELECT DISTINCT trim(o_orderpriority), trim(o_orderstatus) FROM orders""")
def union_distinct(t):
    pad = F.lit("  ")
    tables = [(t.part, "p_brand", "p_type"), (t.customer, "c_mktsegment", "c_mktsegment"),
              (t.orders, "o_orderpriority", "o_orderstatus")]
    return U.union_distinct([
        df.select(fn.strip(F.concat(pad, a)).alias("make"), fn.strip(F.concat(b, pad)).alias("model"))
        for df, a, b in tables])


COPY = """(SELECT c_custkey, c_name, CASE WHEN c_nationkey = 7 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal,
                  CASE WHEN c_acctbal > 9000 THEN NULL ELSE c_mktsegment END AS c_mktsegment
           FROM {customer} WHERE c_nationkey <> 11)"""


COMPARE_SQL = f"""
WITH a AS (SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_nationkey <> 12),
     b AS {COPY.format(customer='customer')},
     j AS (SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, a.c_custkey IS NULL AS no_a,
                  b.c_custkey IS NULL AS no_b, a.c_acctbal AS a_bal, b.c_acctbal AS b_bal,
                  a.c_mktsegment AS a_seg, b.c_mktsegment AS b_seg
           FROM a FULL JOIN b ON a.c_custkey = b.c_custkey)
SELECT c_custkey, CASE WHEN no_b THEN 'only_a' ELSE 'only_b' END AS side, NULL AS column_name,
       NULL AS a_value, NULL AS b_value FROM j WHERE no_a OR no_b
UNION ALL SELECT c_custkey, 'changed', 'c_acctbal', CAST(a_bal AS VARCHAR), CAST(b_bal AS VARCHAR)
FROM j WHERE NOT no_a AND NOT no_b AND abs(a_bal - b_bal) > 0.5
UNION ALL SELECT c_custkey, 'changed', 'c_mktsegment', a_seg, b_seg
FROM j WHERE NOT no_a AND NOT no_b AND a_seg IS DISTINCT FROM b_seg"""


@query("dataset_compare", COMPARE_SQL)
def dataset_compare(t):
    a = t.customer.where("c_nationkey <> 12").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    b = t.sql(f"SELECT * FROM {COPY}", "customer")
    return U.dataset_compare(a, b, ["c_custkey"], tol=0.5)


@query("large_dataset_compare", """
SELECT l_orderkey, l_linenumber, l_partkey, 'changed' AS side, 'l_quantity' AS column_name,
       CAST(l_quantity AS VARCHAR) AS a_value, CAST(l_quantity + 1 AS VARCHAR) AS b_value
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey % 1000 = 3)""")
def large_dataset_compare(t):
    """A table and a copy of it in which one order in a thousand differs."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    a = t.lineitem.select(*keys, "l_quantity").distinct()
    b = a.withColumn("l_quantity", F.when(F.col("l_orderkey") % 1000 == 3, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    return U.large_dataset_compare(a, b, keys)


@query("dataset_verdict", f"""
WITH a AS (SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer), b AS {COPY.format(customer='customer')}
SELECT (SELECT COUNT(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS n_only_a,
       (SELECT COUNT(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS n_only_b,
       CAST(0 AS BIGINT) AS n_changed, 'FAIL' AS verdict""")
def dataset_verdict(t):
    a = t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return U.compare_verdict(a, t.sql(f"SELECT * FROM {COPY}", "customer"))
