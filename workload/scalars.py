"""Scalar functions, one key each."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepframe import functions as fn
from workload.registry import query


@query("fn_substr", "SELECT p_partkey, substr(p_name, 1, 1) AS first, substr(p_name, 3, 4) AS middle FROM part")
def fn_substr(t):
    return t.part.select("p_partkey", fn.substr("p_name", 1, 1).alias("first"),
                         fn.substr("p_name", 3, 4).alias("middle"))


@query("fn_strip_trim", """
SELECT p_partkey, p_name AS both, '  ' || p_name AS trailing, p_name || '   ' AS leading FROM part""")
def fn_strip_trim(t):
    padded = F.concat(F.lit("  "), "p_name", F.lit("   "))
    return t.part.select("p_partkey", fn.strip(padded).alias("both"),
                         fn.trim_trailing(padded).alias("trailing"), fn.left_trim(padded).alias("leading"))


@query("fn_put_numeric", """
SELECT c_custkey, lpad(coalesce(CAST(CAST(v AS BIGINT) AS VARCHAR), '.'), 8, ' ') AS right_aligned,
       coalesce(CAST(CAST(v AS BIGINT) AS VARCHAR), '.') AS left_aligned,
       CASE WHEN b IS NULL THEN '.' WHEN b = floor(b) THEN CAST(CAST(b AS BIGINT) AS VARCHAR)
            ELSE CAST(b AS VARCHAR) END AS best
FROM (SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING'
                             THEN sign(c_acctbal) * floor(abs(c_acctbal) + 0.5) END AS v,
             CASE WHEN c_nationkey = 3 THEN floor(c_acctbal)
                  WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS b
      FROM customer)""")
def fn_put_numeric(t):
    v = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal"))
    b = F.when(F.col("c_nationkey") == 3, F.floor("c_acctbal").cast("double")).otherwise(v)
    return t.customer.select(
        "c_custkey", fn.put_numeric(v, 8).alias("right_aligned"),
        fn.put_numeric(v, 8, "left").alias("left_aligned"), fn.put_best(b).alias("best"))


@query("fn_input_numeric", """
SELECT c_custkey, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN c_acctbal END AS number
FROM customer""")
def fn_input_numeric(t):
    text = (F.when(F.col("c_mktsegment") == "BUILDING", F.lit("n/a"))
            .when(F.col("c_mktsegment") == "MACHINERY", F.lit("   "))
            .otherwise(F.lpad(F.col("c_acctbal").cast("string"), 12, " ")))
    return t.customer.select("c_custkey", fn.input_numeric(text).alias("number"))


@query("fn_catx", """
SELECT p_partkey, p_size || '-' || p_brand AS two,
       CASE WHEN p_type = 'PROMO' THEN p_brand ELSE p_type || ' ' || p_brand END AS skipping
FROM part""")
def fn_catx(t):
    kind = F.when(F.col("p_type") == "PROMO", F.lit("   ")).otherwise(F.concat(F.lit(" "), "p_type"))
    return t.part.select(
        "p_partkey", fn.catx("-", fn.put_numeric("p_size", 8), "p_brand").alias("two"),
        fn.catx(" ", F.lit(None).cast("string"), kind, F.concat("p_brand", F.lit("  "))).alias("skipping"))


@query("fn_cats", "SELECT p_partkey, p_size || '+' || p_name AS label FROM part")
def fn_cats(t):
    return t.part.select("p_partkey", fn.cats("p_size", F.lit(" + "), F.lit(None), F.concat(
        F.lit("  "), "p_name")).alias("label"))


@query("fn_ifc", """
SELECT p_partkey, CASE WHEN nullif(p_size, 30) IS NULL OR p_size < 15 THEN 'small' ELSE 'large' END AS size_class
FROM part""")
def fn_ifc(t):
    size = F.nullif("p_size", F.lit(30))
    return t.part.select("p_partkey", fn.ifc(fn.missing_lt(size, 15), "small", "large").alias("size_class"))


@query("fn_upcase", "SELECT p_partkey, upper(p_name) AS name FROM part")
def fn_upcase(t):
    return t.part.select("p_partkey", fn.upcase("p_name").alias("name"))


@query("fn_compress", "SELECT p_partkey, replace(p_name, ' ', '') AS name FROM part")
def fn_compress(t):
    return t.part.select("p_partkey", fn.compress(F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("name"))


@query("fn_concat_bars", """
SELECT p_partkey, 'ic delete ' || p_name || ';' AS command,
       p_type || coalesce(nullif(p_brand, 'Brand#7'), '') AS joined
FROM part""")
def fn_concat_bars(t):
    name = fn.trim_trailing(F.concat("p_name", F.lit("   ")))
    return t.part.select("p_partkey", fn.concat_bars("ic delete ", name, ";").alias("command"),
                         fn.concat_bars(F.col("p_type"), F.nullif("p_brand", F.lit("Brand#7"))).alias("joined"))


@query("fn_scan", """
SELECT p_partkey, lower(p_type) AS library, p_brand AS member, '' AS beyond FROM part""")
def fn_scan(t):
    name = F.concat(F.lower("p_type"), F.lit(".."), "p_brand")
    return t.part.select("p_partkey", fn.scan_token(name, 1, ".").alias("library"),
                         fn.scan_token(name, 2, ".").alias("member"),
                         fn.scan_token(name, 3, ".").alias("beyond"))


@query("fn_length", """
SELECT p_partkey, CAST(length(p_name) AS INTEGER) AS n, p_type = 'PROMO' AS blank FROM part""")
def fn_length(t):
    text = F.when(F.col("p_type") == "PROMO", F.lit("  "))
    return t.part.select("p_partkey", fn.text_length(F.concat("p_name", F.lit("  "))).alias("n"),
                         fn.is_blank(text.otherwise(F.col("p_type"))).alias("blank"))


@query("fn_dollar_format", """
SELECT o_orderkey, lpad(CASE WHEN cents IS NULL THEN '.' WHEN length(full_text) <= 8 THEN '$' || full_text
                             WHEN length(full_text) <= 9 THEN full_text
                             ELSE replace(full_text, ',', '') END, 9, ' ') AS price
FROM (SELECT o_orderkey, cents,
             CASE WHEN cents >= 100000 THEN CAST(cents // 100000 AS VARCHAR) || ','
                       || lpad(CAST((cents // 100) % 1000 AS VARCHAR), 3, '0')
                  ELSE CAST(cents // 100 AS VARCHAR) END
             || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS full_text
      FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P'
                                    THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS cents
            FROM orders))""")
def fn_dollar_format(t):
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return t.orders.select("o_orderkey", fn.dollar_format(price, 9, 2).alias("price"))


@query("fn_datetime", """
SELECT event_id, lpad(upper(strftime(ts, '%d%b%Y:%H:%M:%S')), 20, ' ') AS stamp,
       strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
       CASE WHEN microsecond(ts) % 1000000 = 0 THEN ''
            ELSE '.' || lpad(CAST(microsecond(ts) % 1000000 AS VARCHAR), 6, '0') END AS iso,
       CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month
FROM events""")
def fn_datetime(t):
    return t.events.select("event_id", fn.datetime_text("ts").alias("stamp"),
                           fn.datetime_iso("ts").alias("iso"), F.year("ts").alias("year"),
                           F.month("ts").alias("month"))


@query("fn_between_chained", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       coalesce(nullif(l_quantity, 13) > 10 AND nullif(l_quantity, 13) < 20, false) AS inside
FROM lineitem""")
def fn_between_chained(t):
    q = F.nullif("l_quantity", F.lit(13))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                             fn.strictly_between(q, 10, 20).alias("inside"))


@query("fn_missing_all", """
SELECT o_orderkey, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS name,
       o_orderstatus = 'P' AS price_missing
FROM orders""")
def fn_missing_all(t):
    fields = [T.StructField("id", T.LongType()), T.StructField("name", T.StringType())]
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return t.orders.select("o_orderkey", *fn.missing_all(fields),
                           fn.is_missing(price).alias("price_missing"))


@query("fn_json_fields", """
SELECT event_id, CASE WHEN event_type <> 'error' THEN props ->> '$.k' ELSE 'none' END AS k,
       'SQL' AS platform_choice
FROM events""")
def fn_json_fields(t):
    doc = F.when(F.col("event_type") != "error", F.col("props")).otherwise(F.lit("{broken"))
    return t.events.select("event_id", fn.json_field(doc, "k", "none").alias("k"),
                           fn.json_field("props", "platform_choice", "SQL").alias("platform_choice"))


@query("fn_text_head", "SELECT doc_id, left(text, 2000) AS head FROM documents")
def fn_text_head(t):
    return t.documents.select("doc_id", fn.text_head("text").alias("head"))


@query("fn_path_parts", """
SELECT event_id, event_type || '.v' || event_id AS stem, '.json' AS extension,
       'job' || user_id AS job, event_type AS step
FROM events""")
def fn_path_parts(t):
    path = F.concat(F.lit("/out/jobs/job"), "user_id", F.lit("/tasks/"), "event_type", F.lit("/"),
                    "event_type", F.lit(".v"), "event_id", F.lit(".json"))
    return t.events.select("event_id", fn.path_stem(path).alias("stem"),
                           fn.path_extension(path).alias("extension"),
                           fn.path_segment_after(path, "jobs").alias("job"),
                           fn.path_segment_after(path, "tasks").alias("step"))


@query("fn_coalesce_zero", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(nullif(l_quantity, 13), 0) AS quantity
FROM lineitem""")
def fn_coalesce_zero(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                             fn.coalesce_zero(F.nullif("l_quantity", F.lit(13))).alias("quantity"))
