"""Table loads and the three whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepframe import sources as S
from stepframe.operators import load as D
from stepframe.plans import SENTINELS, age_dimension, airlines_job, airlines_read, cars_job
from stepframe.plans.airlines import LAYOUT
from stepframe.session import scratch_path
from workload.registry import query


@query("delete_where", """
SELECT p_partkey, p_name, nullif(p_size, 30) AS p_size FROM part WHERE NOT coalesce(nullif(p_size, 30) > 20, false)""")
def delete_where(t):
    df = t.part.select("p_partkey", "p_name", F.nullif("p_size", F.lit(30)).alias("p_size"))
    return D.delete_where(df, F.col("p_size") > 20)


@query("insert_values", """
SELECT p_partkey, p_name, p_size FROM part
UNION ALL SELECT -1, 'Not available', NULL UNION ALL SELECT -2, 'Unknown', 0""")
def insert_values(t):
    return D.insert_values(t.part.select("p_partkey", "p_name", "p_size"), [
        {"p_partkey": -1, "p_name": "Not available"}, {"p_partkey": -2, "p_name": "Unknown", "p_size": 0}])


@query("update_set", """
SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN upper(p_name) ELSE p_name END AS p_name, 'checked' AS p_brand
FROM part""")
def update_set(t):
    df = D.update_set(t.part.select("p_partkey", "p_name", "p_brand", "p_type"),
                      {"p_name": F.upper("p_name")}, F.col("p_type") == "PROMO")
    return D.update_set(df, {"p_brand": F.lit("checked")}).drop("p_type")


@query("sentinel_members", """
SELECT p_partkey AS id, p_name AS name, p_size AS age FROM part
UNION ALL SELECT -1, 'Not available', NULL UNION ALL SELECT -2, 'Unknown', NULL""")
def sentinel_members(t):
    df = t.part.selectExpr("p_partkey AS id", "p_name AS name", "p_size AS age")
    rows = [{"id": -1, "name": "Not available"}, {"id": -2, "name": "Unknown"}]
    return D.sentinel_members(D.sentinel_members(df, "id", rows), "id", rows)


PART_DIMENSION = T.StructType([
    T.StructField("id", T.LongType(), True, {"label": "Part id"}),
    T.StructField("name", T.StringType(), True, {"label": "Naam", "length": 6}),
    T.StructField("price", T.DoubleType(), True, {"label": "Prijs"}),
    T.StructField("note", T.StringType(), True, {"label": "Note", "length": 24}),
])


@query("table_load_replace", """
SELECT p_partkey AS id, left(p_name, 6) AS name, CASE WHEN p_type <> 'PROMO' THEN p_retailprice END AS price,
       CAST(NULL AS VARCHAR) AS note
FROM part""")
def table_load_replace(t):
    price = F.when(F.col("p_type") == "PROMO", F.lit("n/a")).otherwise(F.col("p_retailprice").cast("string"))
    data = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), price.alias("price"), "p_brand")
    return D.table_load_replace(data, PART_DIMENSION, scratch_path(t.spark, "dimension"))


CHANGE_ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
UPSERT_SQL = """
WITH changes AS (
  SELECT l_orderkey, CASE l_returnflag WHEN 'N' THEN '' WHEN 'A' THEN 'converted' ELSE 'reviewed' END AS status,
         CASE WHEN l_quantity > 25 THEN 'v' || l_partkey END AS target_code, l_shipdate AS changed,
         ROW_NUMBER() OVER (PARTITION BY l_orderkey
           ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn
  FROM lineitem),
folded AS (
  SELECT l_orderkey, arg_max(status, rn) FILTER (status <> '') AS status,
         arg_max(target_code, rn) FILTER (target_code IS NOT NULL) AS target_code,
         COUNT(target_code) AS bumps, MAX(changed) AS changed
  FROM changes GROUP BY l_orderkey)
SELECT o_orderkey AS id, coalesce(status, 'pending') AS status, coalesce(target_code, '') AS target_code,
       CAST(1 + coalesce(bumps, 0) AS INTEGER) AS version, coalesce(changed, o_orderdate) AS updated_at
FROM orders LEFT JOIN folded ON l_orderkey = o_orderkey"""


def task_table(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), F.lit("pending").alias("status"),
                           F.lit("").alias("target_code"), F.lit(1).alias("version"),
                           F.col("o_orderdate").alias("updated_at"))


def change_log(lineitem):
    status = F.when(F.col("l_returnflag") == "N", "").when(F.col("l_returnflag") == "A", "converted")
    code = F.when(F.col("l_quantity") > 25, F.concat(F.lit("v"), "l_partkey"))
    return lineitem.select(F.col("l_orderkey").alias("id"), status.otherwise("reviewed").alias("status"),
                           code.alias("target_code"), *CHANGE_ORDER)


@query("upsert_status", UPSERT_SQL)
def upsert_status(t):
    return D.upsert_status(task_table(t), change_log(t.lineitem), "id", CHANGE_ORDER, ["status", "target_code"],
                           blank_ignored=["status"], version_on="target_code", at="l_shipdate")


@query("cascade_delete", """
WITH gone AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT 'parent' AS level, c_custkey AS id, NULL AS line FROM customer WHERE c_custkey NOT IN (SELECT * FROM gone)
UNION ALL SELECT 'tasks', o_orderkey, NULL FROM orders WHERE o_custkey NOT IN (SELECT * FROM gone)
UNION ALL SELECT 'comments', l_orderkey, l_linenumber FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT * FROM gone))""")
def cascade_delete(t):
    parents = t.customer.selectExpr("c_custkey AS project_id", "c_mktsegment")
    tasks = t.orders.selectExpr("o_orderkey AS task_id", "o_custkey AS project_id")
    comments = t.lineitem.selectExpr("l_orderkey AS task_id", "l_linenumber AS line")
    left = D.cascade_delete(parents, parents.where("c_mktsegment = 'BUILDING'"), "project_id", [
        ("tasks", tasks, "task_id", "project_id"), ("comments", comments, "line", "task_id")])
    return (left["parent"].selectExpr("'parent' AS level", "project_id AS id", "CAST(NULL AS INT) AS line")
            .union(left["tasks"].selectExpr("'tasks'", "task_id", "CAST(NULL AS INT)"))
            .union(left["comments"].selectExpr("'comments'", "task_id", "line")))


@query("counter_upsert", """
WITH c AS (SELECT c_custkey AS user_id, c_nationkey AS request_count FROM customer WHERE c_mktsegment <> 'BUILDING'),
     b AS (SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id)
SELECT coalesce(c.user_id, b.user_id) AS user_id, CAST(2024 AS INTEGER) AS year, CAST(1 AS INTEGER) AS month,
       CAST(greatest(coalesce(request_count, 0), least(60, coalesce(request_count, 0) + coalesce(n, 0))) AS BIGINT)
         AS request_count
FROM c FULL JOIN b ON c.user_id = b.user_id""")
def counter_upsert(t):
    counters = t.customer.where("c_mktsegment <> 'BUILDING'").selectExpr(
        "c_custkey AS user_id", "2024 AS year", "1 AS month", "c_nationkey AS request_count")
    requests = t.events.select("user_id", F.year("ts").alias("year"), F.month("ts").alias("month"))
    return D.counter_upsert(counters, requests, ["user_id", "year", "month"], limit=60)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_SENTINEL_SQL = "".join(
    f"\nUNION ALL SELECT {r['ID_AGE']}, NULL, " + ", ".join(
        _text(r[c]) for c in ("TX_AGE", "TX_AGE_NL", "TX_AGE_FR", "TX_AGE_CLASS", "TX_AGE_CLASS_DESCR_NL",
                              "TX_AGE_CLASS_DESCR_FR")) for r in SENTINELS)


@query("age_dimension_job", f"""
WITH classes AS (SELECT MIN(c_custkey) AS lo, MAX(c_custkey) AS hi FROM customer GROUP BY c_custkey // 25),
     target AS (SELECT c_custkey AS NM_AGE, c_custkey + 1000 AS ID_AGE FROM customer WHERE c_mktsegment = 'BUILDING'),
     keyed AS (SELECT c_custkey AS age, lo, hi, coalesce(ID_AGE, (SELECT MAX(ID_AGE) FROM target)
                 + COUNT(*) FILTER (ID_AGE IS NULL) OVER (ORDER BY c_custkey)) AS id
               FROM customer JOIN classes ON c_custkey BETWEEN lo AND hi LEFT JOIN target ON NM_AGE = c_custkey)
SELECT id AS ID_AGE, age AS NM_AGE, CAST(age AS VARCHAR) AS TX_AGE, CAST(age AS VARCHAR) AS TX_AGE_NL,
       CAST(age AS VARCHAR) AS TX_AGE_FR,
       CASE WHEN hi < 150 THEN lo || '-' || hi ELSE lo || '+' END AS TX_AGE_CLASS,
       CASE WHEN hi < 150 THEN lo || ' t.e.m. ' || hi || ' jaar' ELSE lo || ' jaar of ouder' END
         AS TX_AGE_CLASS_DESCR_NL,
       CASE WHEN hi < 150 THEN lo || ' à ' || hi || ' ans' ELSE lo || ' ans ou plus' END AS TX_AGE_CLASS_DESCR_FR
FROM keyed{_SENTINEL_SQL}""")
def age_dimension_job(t):
    """Customers stand in for the members, so the dimension grows with the table."""
    ages = t.customer.selectExpr("c_custkey AS NM_AGE")
    classes = t.customer.groupBy(F.floor(F.col("c_custkey") / 25)).agg(
        F.min("c_custkey").alias("NM_AGE_MIN"), F.max("c_custkey").alias("NM_AGE_MAX")).select(
        "NM_AGE_MIN", "NM_AGE_MAX")
    target = t.customer.where("c_mktsegment = 'BUILDING'").selectExpr("c_custkey AS NM_AGE",
                                                                     "c_custkey + 1000 AS ID_AGE")
    loaded = age_dimension(ages, classes, target, scratch_path(t.spark, "age-dimension"))
    S.labelled_export(loaded, scratch_path(t.spark, "age-export"), drop=["TX_AGE", "TX_AGE_CLASS"])
    return loaded


AIRLINES_SQL = """
WITH rated AS (
  SELECT *, CASE WHEN cost IS NULL OR cost < 50 THEN 5 WHEN cost > 50 AND cost < 100 THEN 4
                 WHEN cost > 100 AND cost < 150 THEN 3 WHEN cost > 150 AND cost < 200 THEN 2
                 WHEN cost > 200 THEN 1 END AS rating
  FROM (SELECT p_name AS airline, p_retailprice AS speed, CASE WHEN p_type <> 'PROMO' THEN p_size * 5.0 END AS cost
        FROM part))
SELECT 'hbar' AS chart, CAST(rating AS VARCHAR) AS label, COUNT(*) AS n, round(AVG(cost), 4) AS value
FROM rated WHERE rating IS NOT NULL GROUP BY GROUPING SETS ((rating), ())
UNION ALL
SELECT 'vbar', CAST(rating AS VARCHAR), COUNT(*),
       CASE WHEN rating IS NOT NULL THEN round(100.0 * COUNT(*) / SUM(COUNT(rating)) OVER (), 4) END
FROM rated GROUP BY rating
UNION ALL
SELECT 'fastplane', airline, 1, speed FROM rated WHERE speed = (SELECT MAX(speed) FROM rated)
UNION ALL
SELECT 'airlinesP', airline, 1, cost FROM rated WHERE starts_with(airline, 's')"""


def airline_lines(t):
    """Parts written as airline records: name, speed and cost in their columns, the rest blank."""
    values = {"Airline": F.rpad("p_name", 20, " "),
              "Speed": F.lpad(F.col("p_retailprice").cast("decimal(7,1)").cast("string"), 7, " "),
              "TotalopCost": F.when(F.col("p_type") != "PROMO",
                                    F.lpad((F.col("p_size") * 5).cast("string"), 7, " "))}
    pieces = []
    for name, _, first, last in LAYOUT:
        width = last - first + 1
        pieces += [F.coalesce(values.get(name, F.lit(None)), F.lit(" " * width)), F.lit(" ")]
    return t.part.select(F.concat(*pieces))


@query("airlines_job", AIRLINES_SQL)
def airlines(t):
    path = scratch_path(t.spark, "airlines")
    airline_lines(t).write.text(path)
    r = airlines_job(airlines_read(t.spark, path), prefix="s")
    label = F.col("RATING").cast("string").alias("label")
    one = F.lit(1).cast("bigint").alias("n")
    return (r.chart_hbar.select(F.lit("hbar").alias("chart"), label, F.col("_FREQ_").alias("n"),
                                F.round("Mean_TotalopCost", 4).alias("value"))
            .unionByName(r.chart_vbar.select(F.lit("vbar").alias("chart"), label, F.col("COUNT").alias("n"),
                                             F.round("PERCENT", 4).alias("value")))
            .unionByName(r.fastplane.select(F.lit("fastplane").alias("chart"), F.col("Airline").alias("label"),
                                            one, F.col("Speed").alias("value")))
            .unionByName(r.airlines_p.select(F.lit("airlinesP").alias("chart"), F.col("Airline").alias("label"),
                                             one, F.col("TotalopCost").alias("value"))))


PRIORITY_SQL = """CASE c_mktsegment WHEN 'BUILDING' THEN '1-URGENT' WHEN 'MACHINERY' THEN '2-HIGH'
                  WHEN 'HOUSEHOLD' THEN '3-MEDIUM' WHEN 'FURNITURE' THEN '5-LOW' ELSE c_mktsegment END"""


@query("cars_job", f"""
WITH a AS (SELECT o_orderpriority AS make, CAST(o_custkey AS VARCHAR) AS model, o_orderkey, o_totalprice AS msrp,
                  CASE o_orderstatus WHEN 'F' THEN 'USA' WHEN 'O' THEN 'Europe' ELSE 'Asia' END AS origin,
                  CASE WHEN o_totalprice > 250000 THEN 'SUV' ELSE 'Sedan' END AS type,
                  ROW_NUMBER() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderkey) AS rn FROM orders),
     b AS (SELECT {PRIORITY_SQL} AS make, CAST(c_custkey AS VARCHAR) AS model, c_acctbal AS mpg_highway FROM customer)
SELECT a.make, a.model, a.o_orderkey, a.msrp, a.origin, a.type, b.mpg_highway
FROM a LEFT JOIN b ON a.make = b.make AND a.model = b.model
WHERE a.origin = 'Europe' AND a.type = 'SUV' ORDER BY msrp, mpg_highway DESC""")
def cars(t):
    """Orders stand in for cars (three tables by origin), customers for the mileage sheet."""
    origins = {"F": "USA", "O": "Europe", "P": "Asia"}
    tables = [t.orders.where(F.col("o_orderstatus") == status).select(
        F.concat(F.lit(" "), "o_orderpriority").alias("make"),
        F.concat("o_custkey", F.lit("  ")).alias("model"), "o_orderkey",
        F.col("o_totalprice").alias("msrp"), F.lit(origin).alias("origin"),
        F.when(F.col("o_totalprice") > 250000, "SUV").otherwise("Sedan").alias("type"))
        for status, origin in origins.items()]
    mileage = t.customer.selectExpr(f"{PRIORITY_SQL} AS make", "concat('  ', c_custkey) AS model",
                                    "c_acctbal AS mpg_highway")
    return cars_job(tables, mileage, ["o_orderkey"], ["mpg_highway"])
