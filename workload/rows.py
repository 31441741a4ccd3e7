"""Projection, filters and row rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepframe import functions as fn
from stepframe.operators import rows as R
from stepframe.sources import with_labels
from workload.registry import query


@query("select_columns", """
SELECT t1.l_orderkey AS order_id, t1.l_linenumber, t1.l_partkey AS part_id,
       t1.l_quantity AS quantity_lb, t1.l_extendedprice
FROM lineitem t1""")
def select_columns(t):
    t1 = t.lineitem.alias("t1")
    return t1.select(F.col("t1.l_orderkey").alias("order_id"), "t1.l_linenumber",
                     F.col("t1.l_partkey").alias("part_id"),
                     F.col("t1.l_quantity").alias("quantity_lb"), "t1.l_extendedprice")


@query("keep_drop", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def keep_drop(t):
    keep = ["l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_discount"]
    return t.lineitem.select(*keep).drop("l_tax", "l_discount")


@query("column_attributes", """
SELECT p_partkey, left(p_name, 5) AS p_name, left(p_brand, 7) AS p_brand, p_size FROM part""")
def column_attributes(t):
    df = t.part.select("p_partkey", "p_name", "p_brand", "p_size")
    return with_labels(df, {"p_name": "Naam", "p_size": "Âge"}, {"p_name": 5, "p_brand": 7})


@query("derived_arithmetic", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 1.2, 4) AS price_usd,
       nullif(l_quantity, 13) * 2 AS new_var, nullif(l_quantity, 13) + 1 AS x
FROM lineitem""")
def derived_arithmetic(t):
    y = F.nullif("l_quantity", F.lit(13))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(F.col("l_extendedprice") * 1.2, 4).alias("price_usd"),
        (y * 2).alias("new_var"), (y + 1).alias("x"))


@query("band_ladder", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, q AS quantity,
       CASE WHEN q IS NULL OR q < 10 THEN 5 WHEN q > 10 AND q < 20 THEN 4
            WHEN q > 20 AND q < 30 THEN 3 WHEN q > 30 AND q < 40 THEN 2 WHEN q > 40 THEN 1 END AS rating
FROM (SELECT *, nullif(l_quantity, 13) AS q FROM lineitem)""")
def band_ladder(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                           F.nullif("l_quantity", F.lit(13)).alias("quantity"))
    return df.withColumn("rating", fn.band_ladder("quantity", [10, 20, 30, 40], [5, 4, 3, 2, 1]))


@query("binary_branch", """
SELECT p_partkey, CASE WHEN nullif(p_size, 30) > 18 THEN 'adult' ELSE 'minor' END AS category
FROM part""")
def binary_branch(t):
    age = F.nullif("p_size", F.lit(30))
    return t.part.select("p_partkey", fn.binary_branch(age > 18, "adult", "minor").alias("category"))


@query("where_filter", """
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'""")
def where_filter(t):
    df = t.orders.where("o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
    return df.select("o_orderkey", "o_totalprice")


@query("subsetting_if", """
SELECT p_partkey, p_name, p_retailprice * 2 AS double_price FROM part
WHERE substr(p_name, 1, 1) = 's' AND p_retailprice * 2 > 1900""")
def subsetting_if(t):
    df = t.part.withColumn("double_price", F.col("p_retailprice") * 2)
    kept = df.where(F.col("p_name").startswith("s") & (F.col("double_price") > 1900))
    return kept.select("p_partkey", "p_name", "double_price")


BRANDS = ["Brand#1", "Brand#2", "Brand#3", "Brand#5", "Brand#8", "Brand#13", "Brand#21"]


@query("in_list_filter", """
SELECT p_partkey, p_brand, p_type FROM part
WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#5', 'Brand#8', 'Brand#13', 'Brand#21')
  AND p_type IN ('PROMO', 'LARGE', 'SMALL')""")
def in_list_filter(t):
    kept = t.part.where(F.col("p_brand").isin(BRANDS) & F.col("p_type").isin("PROMO", "LARGE", "SMALL"))
    return kept.select("p_partkey", "p_brand", "p_type")


@query("not_blank_filter", """
SELECT c_custkey, c_mktsegment AS fail_code FROM customer
WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')""")
def not_blank_filter(t):
    code = (F.when(F.col("c_mktsegment") == "BUILDING", F.lit("   "))
            .when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")))
    return t.customer.select("c_custkey", code.alias("fail_code")).where(fn.not_blank("fail_code"))


@query("between_filter", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20""")
def between_filter(t):
    return t.lineitem.where(F.col("l_quantity").between(10, 20)).select(
        "l_orderkey", "l_linenumber", "l_quantity")


@query("conditional_delete_route", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'foreign_keys' ELSE 'main' END AS route,
       CASE WHEN o_orderstatus = 'F' THEN 'ic delete ' || o_orderkey || ';' END AS command
FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')""")
def conditional_delete_route(t):
    gone = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")
    command = fn.concat_bars("ic delete ", fn.trim_trailing(F.col("o_orderkey").cast("string")), ";")
    routed = R.route_rows(t.orders, gone, {
        "foreign_keys": (fn.upcase(F.lower("o_orderstatus")) == "F", command)})
    return routed.select("o_orderkey", "route", "command")


@query("declare_defaults", """
SELECT c_custkey, left(coalesce(nullif(c_mktsegment, 'BUILDING'), ''), 6) AS c_mktsegment,
       '' AS icown, 'new' AS state
FROM customer""")
def declare_defaults(t):
    df = t.customer.select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"))
    return R.declare_defaults(df, {"c_mktsegment": (6, ""), "icown": (3, ""), "state": (3, "new state")})


@query("clamp_value", """
SELECT c_custkey, greatest(0.0, least(100.0, c_acctbal)) AS progress FROM customer""")
def clamp_value(t):
    return t.customer.select("c_custkey", fn.clamp("c_acctbal", 0.0, 100.0).alias("progress"))


@query("enum_domain_check", """
SELECT o_orderkey, status, reason IS NULL AS valid, reason FROM (
  SELECT *, CASE WHEN status IS NULL OR status NOT IN
                      ('analyzing', 'ready', 'converting', 'reviewing', 'completed') THEN 'invalid status'
                 WHEN target NOT IN ('sql', 'pyspark') THEN 'invalid target' END AS reason
  FROM (SELECT o_orderkey,
               CASE WHEN o_orderpriority = '5-LOW' THEN 'lost' WHEN o_orderstatus = 'O' THEN 'ready'
                    WHEN o_orderstatus = 'P' THEN 'converting'
                    WHEN o_orderpriority <> '1-URGENT' THEN 'completed' END AS status,
               CASE WHEN o_totalprice > 250000 THEN 'pyspark' WHEN o_totalprice > 50000 THEN 'sql'
                    ELSE 'other' END AS target
        FROM orders))""")
def enum_domain_check(t):
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    df = t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderpriority") == "5-LOW", "lost").when(status == "O", "ready")
        .when(status == "P", "converting")
        .when(F.col("o_orderpriority") != "1-URGENT", "completed").alias("status"),
        F.when(price > 250000, "pyspark").when(price > 50000, "sql").otherwise("other").alias("target"))
    checked = R.enum_domain_check(df, {"status": R.PROJECT_STATUS, "target": R.TARGET_TYPE})
    return checked.select("o_orderkey", "status", "valid", "reason")


@query("status_map", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity > 25 AS has_translation,
       CASE WHEN l_returnflag = 'A' THEN 'converted' WHEN l_returnflag = 'R' THEN 'converting'
            ELSE 'pending' END AS status
FROM lineitem""")
def status_map(t):
    code = F.when(F.col("l_quantity") > 40, "select 1").when(F.col("l_quantity") > 25, " ") \
        .when(F.col("l_quantity") > 10, "")
    flag = F.col("l_returnflag")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        fn.has_text(code).alias("has_translation"),
        F.when(flag == "A", "converted").when(flag == "R", "converting").otherwise("pending").alias("status"))
