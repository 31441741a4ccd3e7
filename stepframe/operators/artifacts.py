"""Artifact tables of migration jobs: completeness, fallbacks, suffix repair, approval, logs.

A listing is a table (job, task, file_name, content) with one row per stored artifact and a
unique file name per job and task.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepframe.functions.scalars import json_field, path_extension, path_segment_after, text_head
from stepframe.operators.ordered import positions

# Tasks of a job with the artifact each must leave ({job} and {ext} are filled in),
# the tasks that may be filled in with a default, and the agent that owns each task.
EXPECTED_FILES = {
    "analyze_sas": "analysis.json",
    "decide_platform": "decision.json",
    "translate_code": "{job}.{ext}",
    "test_and_validate": "validation_report.json",
    "review_and_approve": "final_approval.json",
}
FALLBACK_TASKS = ("test_and_validate", "translate_code")
AGENT_TASKS = {
    "sas_analyst": "analyze_sas",
    "platform_architect": "decide_platform",
    "code_translator": "translate_code",
    "test_engineer": "test_and_validate",
    "code_reviewer": "review_and_approve",
}
CONTEXT_SUFFIXES = (".json", ".txt", ".sql", ".py")
CONTEXT_HEAD = 2000
CODE_TASK, DECISION_TASK = "translate_code", "decide_platform"
# Default contents.
FALLBACK_REPORT = json.dumps({
    "verdict": "SKIPPED",
    "test_summary": "Test execution skipped due to environment limitations",
    "execution_results": "Unable to execute code validation",
    "data_coverage": [],
    "test_files_created": [],
    "recommendations": ["Manual validation recommended"],
    "code_quality_notes": "Syntax validation only, no execution testing performed",
}, indent=2)
FALLBACK_SQL = """-- FALLBACK: Agent failed to generate translation
-- This is a minimal stub - manual review required

SELECT
    *
FROM
    input_table
WHERE
    1=1;
"""
FALLBACK_PY = """# FALLBACK: Agent failed to generate translation
# This is a minimal stub - manual review required

from pyspark.sql import SparkSession

spark = SparkSession.builder.appName("Translation").getOrCreate()

df = spark.read.format("csv").load("input_path")
df.show()
"""


def code_suffixes(jobs: DataFrame, listing: DataFrame) -> DataFrame:
    """(job, ext) for every job: 'py' if its decision document says exactly PySpark, else 'sql'."""
    decision = listing.where((F.col("task") == DECISION_TASK)
                             & (F.col("file_name") == EXPECTED_FILES[DECISION_TASK]))
    python = json_field("content", "platform_choice") == "PySpark"
    chosen = decision.select("job", python.alias("_py")).groupBy("job").agg(F.max("_py").alias("_py"))
    ext = F.when(F.col("_py"), F.lit("py")).otherwise(F.lit("sql"))
    return jobs.select("job").join(chosen, "job", "left").select("job", ext.alias("ext"))


def artifact_completeness(jobs: DataFrame, listing: DataFrame, content: bool = True) -> DataFrame:
    """Each expected artifact (five per job), whether it is there, and its content unless told otherwise.

    Which files of a job are there comes from flags by a hash aggregate that reads no text; the
    text of decision documents alone is read for the suffix.  Contents are fetched by one
    equality join on the file, where they are asked for.
    """
    names = {t: F.lit(n) for t, n in EXPECTED_FILES.items() if t != CODE_TASK}
    names |= {f"{CODE_TASK}.{x}": F.concat("job", F.lit(f".{x}")) for x in ("sql", "py")}
    slot = F.when(F.lit(False), F.lit(""))
    for s, name in names.items():
        slot = slot.when((F.col("task") == s.split(".")[0]) & (F.col("file_name") == name), F.lit(s))
    files = listing.withColumn("_slot", slot).where("_slot is not null")
    found = files.select("job", "_slot").groupBy("job").agg(*[
        F.max(F.col("_slot") == s).alias(f"_{s}") for s in names])
    rows = code_suffixes(jobs, listing).join(found, "job", "left")

    def entry(task: str) -> Column:
        name, there = F.lit(EXPECTED_FILES[task]), F.col(f"`_{task}`") if task != CODE_TASK else None
        if task == CODE_TASK:
            name = F.concat_ws(".", "job", "ext")
            there = F.when(F.col("ext") == "py", F.col(f"`_{task}.py`")).otherwise(F.col(f"`_{task}.sql`"))
        return F.struct(F.lit(task).alias("task"), name.alias("file_name"),
                        F.coalesce(there, F.lit(False)).alias("present"))

    every = rows.select("job", "ext", F.inline(F.array(*[entry(t) for t in EXPECTED_FILES])))
    if not content:
        return every.select("job", "task", "ext", "file_name", "present")
    texts = files.select("job", "task", "file_name", "content")
    return every.join(texts, ["job", "task", "file_name"], "left").select(
        "job", "task", "ext", "file_name", "content", "present")


def job_verdict(completeness: DataFrame) -> DataFrame:
    """Per job: artifacts present and whether all are.  Completeness without content is enough."""
    present = F.count(F.when(F.col("present"), 1)).cast("bigint")
    return completeness.groupBy("job").agg(
        present.alias("n_present"),
        F.min("present").alias("complete"))


def artifact_fallback(completeness: DataFrame) -> DataFrame:
    """Absent artifacts of the optional tasks filled with a marked default; they count as present."""
    fill = ~F.col("present") & F.col("task").isin(list(FALLBACK_TASKS))
    default = (F.when(F.col("task") == "test_and_validate", F.lit(FALLBACK_REPORT))
               .when(F.col("ext") == "py", F.lit(FALLBACK_PY))
               .otherwise(F.lit(FALLBACK_SQL)))
    return completeness.withColumns({
        "is_fallback": fill,
        "content": F.when(fill, default).otherwise(F.col("content")),
        "present": F.col("present") | fill})


def suffix_reconcile(jobs: DataFrame, listing: DataFrame) -> DataFrame:
    """Code stored with the other suffix is listed under the expected name.

    Only where the expected file is not there; files of unknown jobs stay as they are.  Run this before ``artifact_fallback``, or the
    default would hide good code.
    """
    ext = code_suffixes(jobs, listing)
    names = F.col("file_name").isin(F.concat("job", F.lit(".sql")), F.concat("job", F.lit(".py")))
    is_code = F.coalesce((F.col("task") == CODE_TASK) & names, F.lit(False))
    code = listing.where(is_code).join(ext, "job", "left")
    code = code.withColumn("_expected", F.concat_ws(".", "job", "ext"))
    # At most two rows per job meet in this window: the two possible names of its code file.
    has = F.max(F.col("file_name") == F.col("_expected")).over(Window.partitionBy("job"))
    fixed = code.withColumn("renamed", ~has & F.col("ext").isNotNull()).withColumn(
        "file_name", F.when(F.col("renamed"), F.col("_expected")).otherwise(F.col("file_name")))
    others = listing.where(~is_code).withColumn("renamed", F.lit(False))
    return others.unionByName(fixed.select(*others.columns))


def approval_rollup(verdicts: DataFrame, issues: DataFrame) -> DataFrame:
    """Approval per job from its test verdict and the issues found.

    A critical issue rejects; skipped tests give approval with notes; anything else is approved.
    """
    found = issues.groupBy("job").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_issues"),
        F.count(F.when(F.col("severity") == "critical", 1)).cast("bigint").alias("n_critical"))
    joined = verdicts.join(found, "job", "left").fillna(0, ["n_issues", "n_critical"])
    status = (F.when(F.col("n_critical") > 0, F.lit("REJECTED"))
              .when(F.col("verdict") == "SKIPPED", F.lit("APPROVED_WITH_NOTES"))
              .otherwise(F.lit("APPROVED")))
    return joined.withColumn("approval_status", status)


def agent_of_task(task: str | Column) -> Column:
    task = F.col(task) if isinstance(task, str) else task
    out = F
    for agent, name in AGENT_TASKS.items():
        out = out.when(task == name, F.lit(agent))
    return out


def context_bundle(listing: DataFrame, suffixes: Sequence[str] = CONTEXT_SUFFIXES,
                   head: int = CONTEXT_HEAD, page_size: int = 100,
                   hot_rows: int | None = None) -> DataFrame:
    """What each agent has produced for a job, as one text per page of artifacts.

    Every artifact gives a header line and the first ``head`` characters; parts are joined by a
    blank line in order of file name.  Pages keep a text bounded when a job has very many.
    """
    rows = listing.where(path_extension("file_name").isin(list(suffixes)))
    rows = rows.withColumn("agent", agent_of_task("task")).where(F.col("agent").isNotNull())
    part = F.concat(F.lit("=== "), "file_name", F.lit(" ===\n"),
                    F.coalesce(text_head("content", head), F.lit("")))
    rows = rows.select("job", "agent", "file_name", part.alias("_part"))
    numbered = positions(rows, ["job", "agent"], ["file_name"], "_rn", hot_rows)
    page = F.expr(f"(_rn - 1) div {page_size}").alias("page")
    parts = F.array_sort(F.collect_list(F.struct("_rn", "_part")))
    return numbered.groupBy("job", "agent", page).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_files"),
        F.array_join(F.transform(parts, lambda p: p["_part"]), "\n\n").alias("bundle"))


LOG_LINE = r"^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\] \[([^\]]*)\] Wrote: (.+)$"


def parse_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """Log lines as (logged_at, agent, path, job, step) with ``parsed`` false for other lines.

    Filter on ``parsed`` for the rows and the quarantine.
    """
    at = F.try_to_timestamp(F.regexp_extract(line, LOG_LINE, 1), F.lit("yyyy-MM-dd HH:mm:ss"))
    hit = F.regexp_like(F.col(line), F.lit(LOG_LINE))
    path = F.regexp_extract(line, LOG_LINE, 3)
    return lines.select(
        F.col(line).alias("line"), F.when(hit, at).alias("logged_at"),
        F.when(hit, F.regexp_extract(line, LOG_LINE, 2)).alias("agent"),
        F.when(hit, path).alias("path"),
        F.when(hit, path_segment_after(path, "jobs")).alias("job"),
        F.when(hit, path_segment_after(path, "tasks")).alias("step"),
        (hit & at.isNotNull()).alias("parsed"))
