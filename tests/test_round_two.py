"""Cases outside the stand-in tables: lineage by statement, result types, repeated keys, formats, typed test data."""

import datetime
import decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from stepframe import session
from stepframe.functions import dollar_format, put_best, put_numeric
from stepframe.operators import artifacts, ordered, scripts, sets, testdata


@pytest.mark.parametrize("text, want", [
    ("data a; set usa eu(in=e where=(x=1)) asia end=last; run;", {("usa", "a"), ("eu", "a"), ("asia", "a")}),
    ("data cars; merge cars carsmpg; by make; run;", {("cars", "cars"), ("carsmpg", "cars")}),
    ("proc sql; create table o as select * from f1 a, f2 b, f3 c where a.x = b.x; quit;", {("f1", "o"), ("f2", "o"), ("f3", "o")}),
    ("data a b(keep=x); set s; run;", {("s", "a"), ("s", "b")}),
    ("proc sql; update t2 set x = 1; delete from t3 where y = 2; quit;", {("t2", "t2"), ("t3", "t3")}),
    ("proc sql; create table f as select * from f1; create table g as select * from g1; quit;", {("f1", "f"), ("g1", "g")}),
    ("proc sort data=z; by x; run; proc append base=hist data=z; run;", {("z", "z"), ("z", "hist")}),
    ("proc sql; insert into w select 'from nowhere; x' from v left join u on v.a = u.a; quit;", {("v", "w"), ("u", "w")}),
    ("proc sql; create table n as select * from (select a from inner1 group by a) q join k on 1 = 1; quit;", {("inner1", "n"), ("k", "n")}),
    ("data _null_; set s; run; proc print data=s; run;", set()),
])
def test_lineage_by_statement(spark, text, want):
    steps = scripts.script_step_inventory(spark.createDataFrame([(1, text)], "script_id int, text string"))
    assert {(r.src, r.dst) for r in scripts.script_lineage_edges(steps).collect()} == want


def test_macro_edges(spark):
    df = spark.createDataFrame([(1, "%macro load(x); %let y = 1; %clean(y) %mend; %Load(1); /* %gone */ '%text'")], "script_id int, text string")
    assert {(r.macro, r.role) for r in scripts.script_macro_edges(df).collect()} == {("load", "defined"), ("load", "called"), ("clean", "called")}


@pytest.mark.parametrize("value", ["bigint", "decimal(10,2)", "double", "smallint"])
def test_both_ways_give_one_schema(spark, value):
    df = spark.range(60).select((F.col("id") % 2).alias("g"), F.col("id").alias("i")).withColumns(
        {"v": F.col("i").cast(value), "d": F.date_add(F.lit("2020-01-01").cast("date"), F.col("i").cast("int")), "s": F.struct("i", "g")})
    one, two = (ordered.running(df, ["g"], ["i"], {"total": F.col("v")}, {"day": F.col("d"), "last": F.col("s")}, path=p)
                for p in ("window", "chunked"))
    assert dict(one.dtypes) == dict(two.dtypes)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.select(one.columns).collect()))


def test_scratch_is_released(spark):
    with session.scratch(spark):
        path = session.scratch_path(spark, "gone")
        spark.range(3).write.parquet(path)
        assert spark.read.parquet(path).count() == 3
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files)


def test_repeated_request_keys_stay_single(spark):
    df = spark.createDataFrame([(1, "u", 1), (1, "u", 2), (1, "u", 3)], "k int, u string, ts int")
    got = ordered.usage_limit_flag(df, ["u"], ["ts"], 2, "k").orderBy("ts").collect()
    assert [(r.accepted, r.used_after) for r in got] == [(True, 1), (True, 2), (False, 2)]


def test_code_of_unknown_jobs_stays(spark):
    jobs = spark.createDataFrame([("j1",)], "job string")
    listing = spark.createDataFrame([("j9", "translate_code", "j9.sql", "select"), ("j9", None, "note", "x")],
                                    "job string, task string, file_name string, content string")
    got = artifacts.suffix_reconcile(jobs, listing).collect()
    assert sorted((r.file_name, r.renamed) for r in got) == [("j9.sql", False), ("note", False)]


def test_formats(spark):
    row = spark.range(1).select(put_best(F.lit(12345678.5)), put_best(F.lit(0.0001)), put_best(F.lit(5.0)), put_numeric(F.lit(1e20), 8),
                                dollar_format(F.lit(0.125)), put_numeric(F.lit(None).cast("double"), 3)).first()
    assert tuple(row) == ("12345678.5", "0.0001", "5", "********", "$0.13", "  .") or tuple(v.strip() for v in row) == (
        "12345678.5", "0.0001", "5", "********", "$0.13", ".")


def test_typed_baseline_and_scaled_keys(spark):
    day = datetime.date(2020, 1, 1)
    source = spark.createDataFrame([(day, datetime.datetime(2020, 1, 1, 3), True, decimal.Decimal("1.50")),
                                    (day + datetime.timedelta(9), datetime.datetime(2020, 1, 2), False, decimal.Decimal("2.50"))],
                                   "d date, t timestamp, b boolean, m decimal(5,2)")
    made = testdata.testdata_baseline(spark.range(40), "id", source, ["d", "t", "b", "m"])
    assert dict(made.dtypes) == {"id": "bigint", **dict(source.dtypes)}
    assert made.agg(F.min("d") >= F.lit(day), F.max("d") <= F.lit(day + datetime.timedelta(9)), F.count_distinct("b") == 2).first() == (True, True, True)
    keys = spark.createDataFrame([(-2,), (-1,), (0,), (5,), (10,)], "k int")
    assert testdata.testdata_stress(keys, 3, ["k"]).select("k").distinct().count() == 15


def test_compare_needs_equal_columns(spark):
    a = spark.range(3)
    with pytest.raises(ValueError):
        sets.dataset_compare(a, a.withColumn("more", F.lit(1)), ["id"])
    with pytest.raises(ValueError):
        sets.dataset_compare(a, a, tol=0.1)


def test_blank_classes_are_missing(spark):
    from stepframe.functions import is_missing
    from stepframe.operators.summary import class_means, freq_oneway
    df = spark.createDataFrame([("a", 1.0), ("a  ", 3.0), ("", 5.0), ("  ", 7.0), (None, 9.0)], "c string, x double")
    assert sorted(((r.c, r.COUNT, r.PERCENT) for r in freq_oneway(df, "c").collect()), key=str) == [("a", 2, 100.0), (None, 3, None)]
    got = class_means(df, ["c"], {"m": ("mean", "x")}).collect()
    assert sorted(((r.c, r["_FREQ_"], r.m) for r in got), key=str) == [("a", 2, 2.0), (None, 2, 2.0)]
    assert [r[0] for r in df.select(is_missing("c")).collect()] == [False, False, True, True, True]


def test_failed_replace_leaves_the_old_table(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    session.replace_table(spark.range(3), path)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        session.replace_table(spark.range(5).select((F.lit(1) / F.col("id")).alias("id")), path)
    assert spark.read.parquet(path).count() == 3
    session.replace_table(spark.read.parquet(path).unionAll(spark.range(2)), path)
    assert spark.read.parquet(path).count() == 5


@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2)), max_size=12),
       st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2)), max_size=12), st.sampled_from([None, 1]))
@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_compare_pairs_repeated_keys_by_position(spark, left, right, hot):
    from collections import Counter
    a = spark.createDataFrame(left, "k int, v int")
    b = spark.createDataFrame(right, "k int, v int")
    assert sets.dataset_compare(a, a, ["k"], hot_rows=hot).count() == 0
    want = []
    for k in range(3):
        va, vb = Counter(v for q, v in left if q == k), Counter(v for q, v in right if q == k)
        x, y = sorted((va - vb).elements()), sorted((vb - va).elements())
        n = min(len(x), len(y))
        want += [(k, "changed", "v", str(p), str(q)) for p, q in zip(x, y)]
        want += [(k, "only_a", None, None, None)] * (len(x) - n) + [(k, "only_b", None, None, None)] * (len(y) - n)
    assert sorted(map(str, sets.dataset_compare(a, b, ["k"], hot_rows=hot).collect())) == sorted(
        str(Row(k=k, side=s, column_name=c, a_value=p, b_value=q)) for k, s, c, p, q in want)


def test_compare_writes_each_surplus_row(spark):
    a = spark.range(2500).selectExpr("1 AS k", "'x' AS v")
    verdict = sets.compare_verdict(a, a.limit(0), ["k"]).first()
    assert (verdict.n_only_a, verdict.n_only_b, verdict.n_changed, verdict.verdict) == (2500, 0, 0, "FAIL")


def test_counters_share_one_shuffle(spark):
    from stepframe.operators.load import counter_upsert
    counters = spark.createDataFrame([("u", 3), (None, 1), ("w", None)], "u string, request_count bigint")
    events = spark.createDataFrame([("u",), ("u",), (None,), ("w",), ("new",)], "u string")
    made = counter_upsert(counters, events, ["u"], limit=4)
    assert {r.u: r.request_count for r in made.collect()} == {"u": 4, None: 2, "w": 1, "new": 1}
    plan = made._jdf.queryExecution().sparkPlan().toString() + made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and made._jdf.queryExecution().executedPlan().toString().count("Exchange hash") <= 2


def test_verdict_reads_no_content_but_of_decisions(spark, tmp_path):
    from stepframe.operators import artifacts as R
    path = f"file://{tmp_path}/listing"
    spark.createDataFrame([("j", "decide_platform", "decision.json", '{"platform_choice": "PySpark"}'),
                           ("j", "translate_code", "j.py", "x"), ("k", "translate_code", "k.py", "y"),
                           ("k", "analyze_sas", "analysis.json", None)],
                          "job string, task string, file_name string, content string").write.parquet(path)
    jobs, listing = spark.createDataFrame([("j",), ("k",), ("m",)], "job string"), spark.read.parquet(path)
    verdict = R.job_verdict(R.artifact_completeness(jobs, listing, content=False))
    assert {r.job: r.n_present for r in verdict.collect()} == {"j": 2, "k": 1, "m": 0}
    plan = verdict._jdf.queryExecution().optimizedPlan().toString()
    assert "SortAggregate" not in verdict._jdf.queryExecution().sparkPlan().toString()
    scans = [s for s in verdict._jdf.queryExecution().sparkPlan().toString().split("\n") if "ReadSchema" in s]
    assert len(scans) == 2, plan
    assert all("EqualTo(task,decide_platform)" in s for s in scans if "content:string" in s)
    full = {(r.job, r.task): r.content for r in R.artifact_completeness(jobs, listing).collect()}
    assert len(full) == 15 and full["j", "translate_code"] == "x" and full["k", "translate_code"] is None


def test_repeated_run_logs_once(spark, tmp_path):
    from stepframe.sources import audit_log_append
    writes = spark.sql("""SELECT TIMESTAMP_NTZ '2024-01-01 10:00:00' AS at, 'a1' AS agent,
                          concat('/o/jobs/', id, '/tasks/007/f.json') AS path FROM range(50)""")
    for run in ("one", "one", "two"):
        log = audit_log_append(spark, writes, "at", "agent", "path", f"file://{tmp_path}/log", run=run)
    assert log.count() == 100 and log.columns == ["job", "step", "line"]
    assert {r.step for r in log.select("step").collect()} == {"007"}


def test_endless_ranges_are_spread(spark):
    from stepframe.operators.joins import range_join
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(20_000).selectExpr("id", "CAST(id % 100 AS double) AS v")
        ranges = spark.createDataFrame([(None, 49.5, "low"), (90.0, 95.0, "high")], "lo double, hi double, label string")
        sizes = [r[0] for r in range_join(df, ranges, "v", "lo", "hi").groupBy(F.spark_partition_id()).count()
                 .select("count").collect()]
        assert sum(sizes) == 20_000 * 56 // 100 and max(sizes) < 6_000
    finally:
        for k in conf:
            spark.conf.unset(k)
