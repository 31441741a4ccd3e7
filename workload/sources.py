"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepframe import sources as S
from stepframe.functions import put_numeric
from stepframe.operators import load
from stepframe.operators.ordered import dense_row_id
from stepframe.session import scratch_path
from workload.registry import query


@query("library_read", "SELECT * FROM orders")
def library_read(t):
    return S.library_read(t.spark, t.folder, "orders")


@query("fixed_width_read", """
SELECT o_orderpriority AS priority,
       CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderkey AS DOUBLE) END AS order_no,
       o_totalprice AS price
FROM orders""")
def fixed_width_read(t):
    line = F.concat(
        F.rpad("o_orderpriority", 20, " "), F.lit(" "),
        F.when(F.col("o_orderstatus") == "P", F.lit("         ?"))
        .otherwise(F.lpad(F.col("o_orderkey").cast("string"), 10, " ")), F.lit(" "),
        F.lpad(F.col("o_totalprice").cast("decimal(12,2)").cast("string"), 12, " "))
    path = scratch_path(t.spark, "lines")
    t.orders.select(line).write.text(path)
    return S.fixed_width_read(t.spark, path, [
        ("priority", "char", 1, 20), ("order_no", "num", 22, 31), ("price", "num", 33, 44)])


@query("sheet_import", """
SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment
FROM customer""")
def sheet_import(t):
    path = scratch_path(t.spark, "sheet")
    t.customer.write.option("header", True).csv(path)
    return S.sheet_import(t.spark, path)


@query("csv_scan", """
SELECT CAST(c_custkey AS VARCHAR) AS _c0, c_name AS _c1, CAST(c_nationkey AS VARCHAR) AS _c2,
       CAST(c_acctbal AS VARCHAR) AS _c3, c_mktsegment AS _c4
FROM customer""")
def csv_scan(t):
    path = scratch_path(t.spark, "csv")
    t.customer.write.csv(path)
    return S.csv_scan(t.spark, path)


@query("library_write", "SELECT * FROM lineitem")
def library_write(t):
    library = scratch_path(t.spark, "library")
    S.library_write(t.lineitem, library, "lineitem")
    return S.library_read(t.spark, library, "lineitem")


@query("create_table_as", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'""")
def create_table_as(t):
    finished = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_totalprice")
    return S.create_table_as(finished, "stepframe_finished_orders", scratch_path(t.spark, "ctas"))


@query("create_view", """
SELECT p_brand, COUNT(*) AS n_parts FROM part WHERE p_type = 'PROMO' GROUP BY p_brand""")
def create_view(t):
    promo = S.create_view(t.part.where("p_type = 'PROMO'"), "stepframe_promo_parts")
    return promo.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_parts"))


SUPPLIER_LABELS = {"s_suppkey": "Supplier id", "s_acctbal": "Saldo", "s_nationkey": "Pays d'origine"}


@query("labelled_export", """
SELECT CAST(s_suppkey AS INTEGER) AS "Supplier id", s_nationkey AS "Pays d'origine",
       s_acctbal AS "Saldo"
FROM supplier""")
def labelled_export(t):
    path = scratch_path(t.spark, "export")
    S.labelled_export(S.with_labels(t.supplier, SUPPLIER_LABELS), path, drop=["s_name"])
    return S.sheet_import(t.spark, path)


@query("append_force", """
SELECT s_suppkey AS id, left(s_name, 12) AS name, s_acctbal AS balance, s_nationkey AS nation
FROM supplier
UNION ALL
SELECT c_custkey, left(c_name, 12), c_acctbal, NULL FROM customer""")
def append_force(t):
    base = t.supplier.selectExpr("s_suppkey AS id", "s_name AS name", "s_acctbal AS balance",
                                 "s_nationkey AS nation")
    base = S.with_labels(base, {"name": "Name"}, {"name": 12})
    data = t.customer.selectExpr("c_custkey AS id", "c_mktsegment AS segment", "c_name AS name",
                                 "c_acctbal AS balance")
    return load.append_force(base, data)


@query("preview_rows", """
SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def preview_rows(t):
    return S.preview_rows(t.orders, [F.col("o_totalprice").desc(), "o_orderkey"], 100)


@query("generate_series_rows", """
SELECT p_partkey, CAST(nm_age AS INTEGER) AS nm_age, CAST(nm_age AS VARCHAR) AS tx_age
FROM part, LATERAL (SELECT unnest(generate_series(0, p_size)) AS nm_age)""")
def generate_series_rows(t):
    rows = S.expand_loop(t.part.select("p_partkey", "p_size"), 0, F.col("p_size"), "nm_age")
    return rows.select("p_partkey", "nm_age", put_numeric("nm_age", 8, "left").alias("tx_age"))


@query("script_ingest", r"""
WITH files AS (
  SELECT source || '_' || doc_id || CASE WHEN lang = 'es' THEN '.txt' ELSE '.sas' END AS name,
         CASE WHEN n_chars < 200 THEN '  ' ELSE text END AS text, source = 'src3' AS broken
  FROM documents)
SELECT name,
       CASE WHEN name NOT LIKE '%.sas' THEN 'rejected_name'
            WHEN broken THEN 'rejected_encoding'
            WHEN regexp_replace(text, '\s+', '', 'g') = '' THEN 'skipped_blank'
            ELSE 'accepted' END AS status,
       CASE WHEN NOT broken THEN CAST(length(text) AS INTEGER) END AS n_chars
FROM files""")
def script_ingest(t):
    suffix = F.when(F.col("lang") == "es", F.lit(".txt")).otherwise(F.lit(".sas"))
    text = F.when(F.col("n_chars") < 200, F.lit("  ")).otherwise(F.col("text"))
    binary = F.encode(text, "UTF-8")
    # A stray byte that no UTF-8 text has makes the files of one source unreadable.
    content = F.when(F.col("source") == "src3", F.concat(binary, F.unhex(F.lit("FF"))))
    files = t.documents.select(F.concat("source", F.lit("_"), "doc_id", suffix).alias("name"),
                               content.otherwise(binary).alias("content"))
    return S.script_ingest(files).select("name", "status", F.length("text").alias("n_chars"))


@query("audit_log_append", """
SELECT CAST(user_id AS VARCHAR) AS job, event_type AS step,
       '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] [agent_' || event_type || '] Wrote: /out/jobs/'
       || user_id || '/tasks/' || event_type || '/' || event_id || '.json' AS line
FROM events""")
def audit_log_append(t):
    path = F.format_string("/out/jobs/%s/tasks/%s/%s.json", F.col("user_id").cast("string"),
                           "event_type", F.col("event_id").cast("string"))
    writes = t.events.select("ts", F.concat(F.lit("agent_"), "event_type").alias("agent"),
                             path.alias("path"))
    log = scratch_path(t.spark, "audit-log")
    return S.audit_log_append(t.spark, writes, "ts", "agent", "path", log)


@query("switched_table", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F'""")
def switched_table(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    place = scratch_path(t.spark, "switched")
    # The first switch makes the table or changes its columns, the second reads the table that it replaces.
    S.switch_table(rows, "stepframe_switched_orders", place)
    S.switch_table(t.spark.table("stepframe_switched_orders").where("o_orderstatus <> 'F'"), "stepframe_switched_orders", place)
    return t.spark.table("stepframe_switched_orders").drop("o_orderstatus")


def in_order(t, name):
    return S.read_in_order(t.spark, f"{t.folder}/{name}.parquet")


@query("observation_number", "SELECT l_orderkey, l_linenumber, l_partkey, ROW_NUMBER() OVER () AS _n_ FROM lineitem")
def observation_number(t):
    return S.observation_numbers(in_order(t, "lineitem")).select("l_orderkey", "l_linenumber", "l_partkey", "_n_")


@query("stable_sort", """
SELECT o_orderkey, o_orderpriority, ROW_NUMBER() OVER (ORDER BY o_orderpriority, n) AS place
FROM (SELECT *, ROW_NUMBER() OVER () AS n FROM orders)""")
def stable_sort(t):
    rows = in_order(t, "orders")
    placed = dense_row_id(rows.select("o_orderkey", "o_orderpriority", "input_file", "input_row"),
                          ["o_orderpriority", "input_file", "input_row"], out="place")
    return placed.drop("input_file", "input_row")


@query("first_in_input", """
SELECT user_id, event_id, event_type FROM (SELECT *, ROW_NUMBER() OVER () AS n FROM events)
QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY n) = 1""")
def first_in_input(t):
    rows = in_order(t, "events").select("user_id", "event_id", "event_type", "input_file", "input_row")
    return S.first_in_input(rows, ["user_id"])


@query("merge_by_position", """
SELECT CASE WHEN s.n IS NOT NULL THEN s.s_suppkey ELSE c.c_custkey END AS id, c.c_name, s.s_name,
       CASE WHEN s.n IS NOT NULL THEN s.s_acctbal ELSE c.c_acctbal END AS balance
FROM (SELECT *, ROW_NUMBER() OVER () AS n FROM customer) c
FULL JOIN (SELECT *, ROW_NUMBER() OVER () AS n FROM supplier) s ON c.n = s.n""")
def merge_by_position(t):
    left = in_order(t, "customer").withColumnsRenamed({"c_custkey": "id", "c_acctbal": "balance"})
    right = in_order(t, "supplier").withColumnsRenamed({"s_suppkey": "id", "s_acctbal": "balance"})
    return S.merge_by_position(left, right).select("id", "c_name", "s_name", "balance")


@query("quarantined_lines", """
SELECT o_orderkey AS line_no,
       CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS customer,
       CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS day,
       CASE WHEN o_orderkey % 11 <> 0 AND o_orderstatus <> 'P' THEN o_orderpriority END AS priority,
       CASE WHEN o_orderkey % 11 = 0 THEN 'too few fields' WHEN o_orderkey % 13 = 0 THEN 'too many fields'
            WHEN o_orderkey % 7 = 0 THEN 'not a bigint: customer'
            WHEN o_orderkey % 5 = 0 THEN 'not a date: day' END AS reason,
       CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 5 = 0
            THEN 'rejected' ELSE 'accepted' END AS status
FROM (SELECT * REPLACE (CAST(o_orderdate AS DATE) AS o_orderdate) FROM orders)""")
def quarantined_lines(t):
    k = F.col("o_orderkey")
    line = F.concat(
        k, F.lit(","), F.when(k % 7 == 0, F.lit("n/a")).otherwise(F.col("o_custkey").cast("string")),
        F.lit(","), F.when(k % 5 == 0, F.lit("someday")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")),
        F.when(k % 11 == 0, F.lit("")).otherwise(F.concat(
            F.lit(","), F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(F.concat(F.lit('"'), "o_orderpriority", F.lit('"'))),
            F.when(k % 13 == 0, F.lit(",more")).otherwise(F.lit("")))))
    path = scratch_path(t.spark, "delimited")
    t.orders.select(line).write.text(path)
    read = S.lines_with_status(t.spark.read.text(path), "line_no bigint, customer bigint, day date, priority string")
    return read.drop("value")


@query("quarantined_fixed_width", """
SELECT CASE WHEN c_custkey % 9 <> 0 AND c_custkey % 4 <> 0 THEN CAST(c_custkey AS DOUBLE) END AS id,
       CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment ELSE '' END AS segment,
       CASE WHEN c_custkey % 9 = 0 THEN 'too few fields' WHEN c_custkey % 8 = 0 THEN 'not a number: id' END AS reason,
       CASE WHEN c_custkey % 9 = 0 OR c_custkey % 8 = 0 THEN 'rejected' ELSE 'accepted' END AS status
FROM customer""")
def quarantined_fixed_width(t):
    k = F.col("c_custkey")
    number = F.when(k % 8 == 0, F.lit("12x")).when(k % 4 == 0, F.lit(".")).otherwise(k.cast("string"))
    line = F.when(k % 9 == 0, F.lit("")).otherwise(F.concat(F.rpad(number, 12, " "), "c_mktsegment"))
    path = scratch_path(t.spark, "fixed")
    t.customer.select(line).write.text(path)
    read = S.fixed_width_with_status(t.spark.read.text(path), [("id", "num", 1, 12), ("segment", "char", 13, 40)])
    return read.drop("value")
