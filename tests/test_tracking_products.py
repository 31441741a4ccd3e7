"""Artifacts, scripts and test data."""

import json

from pyspark.sql import functions as F

from stepframe.operators import artifacts as R
from stepframe.operators import scripts as C
from stepframe.operators import summary as A
from stepframe.operators import testdata as X

LISTING = [
    ("j1", "analyze_sas", "analysis.json", "{}"),
    ("j1", "decide_platform", "decision.json", '{"platform_choice": "PySpark"}'),
    ("j1", "translate_code", "j1.sql", "select 1"),
    ("j1", "review_and_approve", "final_approval.json", "{}"),
    ("j2", "decide_platform", "decision.json", '{"platform_choice": "pyspark"}'),
    ("j2", "translate_code", "j2.sql", "select 2"),
    ("j2", "translate_code", "j2.py", "print(2)"),
    ("j2", "translate_code", "notes.txt", "n" * 3000),
    ("j2", "translate_code", "big.bin", "?"),
]


def tables(spark):
    jobs = spark.createDataFrame([("j1",), ("j2",), ("j3",)], "job string")
    return jobs, spark.createDataFrame(LISTING, "job string, task string, file_name string, content string")


def test_completeness(spark):
    jobs, listing = tables(spark)
    done = R.artifact_completeness(jobs, listing)
    assert done.count() == 15
    present = {(r.job, r.task): (r.file_name, r.present) for r in done.collect()}
    assert present["j1", "translate_code"] == ("j1.py", False)
    assert present["j2", "translate_code"] == ("j2.sql", True)
    assert present["j3", "translate_code"] == ("j3.sql", False)
    verdict = {r.job: (r.n_present, r.complete) for r in R.job_verdict(done).collect()}
    assert verdict == {"j1": (3, False), "j2": (2, False), "j3": (0, False)}


def test_suffix_repair_comes_before_fallback(spark):
    jobs, listing = tables(spark)
    repaired = R.suffix_reconcile(jobs, listing)
    assert repaired.count() == len(LISTING)
    names = {(r.job, r.file_name): r.renamed for r in repaired.collect()}
    assert names["j1", "j1.py"] is True and ("j1", "j1.sql") not in names
    assert names["j2", "j2.py"] is False and names["j2", "j2.sql"] is False
    filled = R.artifact_fallback(R.artifact_completeness(jobs, repaired.drop("renamed")))
    got = {(r.job, r.task): r for r in filled.collect()}
    assert got["j1", "translate_code"].content == "select 1" and not got["j1", "translate_code"].is_fallback
    assert got["j3", "translate_code"].content == R.FALLBACK_SQL and got["j3", "translate_code"].is_fallback
    assert json.loads(got["j1", "test_and_validate"].content)["verdict"] == "SKIPPED"
    assert not got["j3", "analyze_sas"].present and not got["j3", "analyze_sas"].is_fallback
    assert R.job_verdict(filled).where("complete").select("job").collect()[0].job == "j1"


def test_approval(spark):
    verdicts = spark.createDataFrame([("a", "PASS"), ("b", "SKIPPED"), ("c", "SKIPPED"), ("d", "FAIL")], "job string, verdict string")
    issues = spark.createDataFrame([("a", "minor"), ("c", "critical"), ("c", "minor")], "job string, severity string")
    got = {r.job: (r.n_issues, r.approval_status) for r in R.approval_rollup(verdicts, issues).collect()}
    assert got == {"a": (1, "APPROVED"), "b": (0, "APPROVED_WITH_NOTES"), "c": (2, "REJECTED"), "d": (0, "APPROVED")}


def test_context_bundle(spark):
    _, listing = tables(spark)
    got = {(r.job, r.agent, r.page): r.bundle for r in R.context_bundle(listing).collect()}
    assert got["j2", "code_translator", 0] == (
        "=== j2.py ===\nprint(2)\n\n=== j2.sql ===\nselect 2\n\n=== notes.txt ===\n" + "n" * 2000)
    paged = R.context_bundle(listing, page_size=2, hot_rows=1).where("job = 'j2' and agent = 'code_translator'")
    assert {r.page: r.n_files for r in paged.collect()} == {0: 2, 1: 1}


def test_log_lines(spark):
    lines = ["[2024-01-02 03:04:05] [agent x] Wrote: /o/jobs/j/tasks/s/f.py", "noise",
             "[2024-13-02 03:04:05] [a] Wrote: /f"]
    got = R.parse_log(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [r.parsed for r in got] == [True, False, False]
    assert (got[0].agent, got[0].path, got[0].job, got[0].step) == ("agent x", "/o/jobs/j/tasks/s/f.py", "j", "s")
    assert str(got[0].logged_at) == "2024-01-02 03:04:05" and got[1].path is None


SCRIPT = """/* proc fake; */ %let a = 1;
data work.one; set lib.cars; x = 2; run;
PROC SORT data=work.one out=work.two; by x; run;
proc sql; create table three as select * from work.two join lib.b on 1=1; quit;
"""


def test_steps_and_lineage(spark, as_rows):
    scripts = spark.createDataFrame([(1, SCRIPT), (2, "x = 1;"), (3, None)], "script_id int, text string")
    steps = C.script_step_inventory(scripts)
    assert as_rows(steps.select("script_id", "ordinal", "kind", F.coalesce("proc", F.lit("")))) == [
        (1, 1, "data", ""), (1, 2, "proc", "sort"), (1, 3, "proc", "sql")]
    edges = C.script_lineage_edges(steps)
    assert as_rows(edges) == [(1, "lib.b", "three"), (1, "lib.cars", "work.one"), (1, "work.one", "work.two"),
                              (1, "work.two", "three")]
    assert as_rows(C.script_dependency_count(edges)) == [(1, 4)]


def test_complexity_and_platform(spark):
    many = "data a; run; " * 5
    texts = {1: SCRIPT, 2: many, 3: "%let a=1; " * 3, 4: "%let a=1; " * 6, 5: "proc reg; run;",
             6: "%let a=1; proc glm; run;", 7: "", 8: many * 3, 9: "%let a=1; " + many}
    scripts = spark.createDataFrame(list(texts.items()), "script_id int, text string")
    scored = C.script_complexity(scripts)
    assert {r.script_id: r.score for r in scored.collect()} == {
        1: 3, 2: 5, 3: 7, 4: 8, 5: 9, 6: 10, 7: 1, 8: 6, 9: 5}
    chosen = {r.script_id: r.platform for r in C.platform_decision(scored).collect()}
    assert chosen == {1: "SQL", 2: "SQL", 3: "PySpark", 4: "PySpark", 5: "PySpark", 6: "PySpark", 7: "SQL",
                      8: "PySpark", 9: "PySpark"}
    large = C.platform_decision(scored, F.col("script_id") == 2)
    assert {r.platform for r in large.where("script_id = 2").collect()} == {"PySpark"}


def test_baseline_rows_do_not_depend_on_partitions(spark, as_rows):
    source = spark.createDataFrame([(i, i % 7, float(i % 5), f"t{i % 3}") for i in range(50)],
                                   "id int, a int, b double, t string")
    columns = ["a", "b", "t"]
    one = X.testdata_baseline(source.select("id").coalesce(1), "id", source, columns, seed=3)
    many = X.testdata_baseline(source.select("id").repartition(9), "id", source, columns, seed=3)
    assert as_rows(one) == as_rows(many)
    assert {r.a for r in one.collect()} <= set(range(7)) and {r.b for r in one.collect()} <= {0.0, 1.0, 2.0, 3.0, 4.0}
    other = X.testdata_baseline(source.select("id"), "id", source, columns, seed=4)
    assert as_rows(other) != as_rows(one)


def test_edges_and_stress(spark, as_rows):
    df = spark.createDataFrame([(0, 5, "a"), (1, 9, "b")], "id int, n int, t string")
    edges = X.testdata_edges(A.column_profile(df.select("n", "t")))
    assert as_rows(edges.where("column_name = 'n'")) == [
        ("n", "highest", "9"), ("n", "lowest", "5"), ("n", "missing", None), ("n", "zero", "0")]
    assert ("t", "blank", "") in as_rows(edges)
    scaled = X.testdata_stress(df, 3, ["id"])
    assert sorted(r.id for r in scaled.collect()) == [0, 1, 2, 3, 4, 5]
    assert sorted(r.n for r in scaled.collect()) == [5, 5, 5, 9, 9, 9]
