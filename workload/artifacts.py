"""Scripts, test data and artifacts of migration jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepframe.operators import artifacts as R
from stepframe.operators import scripts as C
from stepframe.operators import testdata as X
from stepframe.session import materialize
from workload.registry import query
from workload.summaries import PROFILE_SQL, order_profile

# Stand-in tables as SQL that both engines read.
SCRIPTS = """(SELECT p_partkey AS script_id,
  '/* job; proc fake; */ data work.d' || CAST(p_partkey AS STRING) || '; set lib.' || lower(p_type) || '; x = 1; run; '
  || CASE WHEN p_size > 10 THEN 'proc sort data=work.d out=work.s' || CAST(p_size AS STRING) || '; by x; run; ' ELSE '' END
  || CASE WHEN p_size > 20 THEN 'DATA m; merge work.s lib.b; by x; run; ' ELSE '' END
  || CASE WHEN p_size > 30 THEN 'proc sql; create table t as select * from m join lib.c on a = b; quit; ' ELSE '' END
  || CASE WHEN p_size > 40 THEN 'proc means data=t; run; data z; set t; run; proc print data=z; run; ' ELSE '' END
  || CASE WHEN p_size > 45 THEN 'proc sort data=z; by x; run; proc append base=hist data=z; run; proc sql; '
       || 'create table f as select a.x from f1 a, f2 b where a.x = b.x; create table g as select 1 as y from g1; '
       || 'update t2 set x = 1; quit; data u1 u2(keep=x); set usa eu(in=e) asia end=last; run; %clean(z); ' ELSE '' END
  || CASE WHEN p_type = 'PROMO' THEN 'proc reg data=m; model y = x; run; ' ELSE '' END
  || CASE WHEN p_type IN ('LARGE', 'PROMO') THEN '%let a = 1; %if 1 %then %do; ' ELSE '' END
  || CASE WHEN p_type = 'LARGE' AND p_size < 25 THEN '%macro m; %let b = 2; %do i = 1 %to 3; ' ELSE '' END AS text
FROM {part})"""
LISTING = """(SELECT 'job' || CAST(l_orderkey AS STRING) AS job,
    CASE line WHEN 1 THEN 'analyze_sas' WHEN 2 THEN 'decide_platform' WHEN 4 THEN 'test_and_validate'
         WHEN 5 THEN 'review_and_approve' ELSE 'translate_code' END AS task,
    CASE line WHEN 1 THEN 'analysis.json' WHEN 2 THEN 'decision.json' WHEN 4 THEN 'validation_report.json'
         WHEN 5 THEN 'final_approval.json'
         WHEN 7 THEN 'notes' || CAST(note AS STRING) || CASE WHEN variant THEN '.txt' ELSE '.log' END
         ELSE 'job' || CAST(l_orderkey AS STRING) || CASE WHEN variant THEN '.py' ELSE '.sql' END END AS file_name,
    CASE WHEN line = 2 AND flag = 1 THEN '{"platform_choice": "PySpark"}'
         WHEN line = 2 AND flag = 2 THEN '{"platform_choice": "pyspark"}'
         WHEN line = 2 THEN '{broken' ELSE 'text of ' || CAST(part AS STRING) END AS content
  FROM (SELECT l_orderkey, CASE WHEN l_linenumber = 6 THEN 3 ELSE l_linenumber END AS line,
               CASE WHEN l_linenumber = 7 THEN l_partkey ELSE 0 END AS note,
               CASE WHEN l_linenumber IN (3, 6) THEN l_returnflag = 'A' ELSE l_linenumber = 7 AND l_quantity > 25 END AS variant,
               MIN(l_partkey) AS part,
               MIN(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END) AS flag
        FROM <lineitem> GROUP BY 1, 2, 3, 4))"""
JOBS = "(SELECT 'job' || CAST(o_orderkey AS STRING) AS job FROM <orders>)"


def _duck(text: str) -> str:
    for name in ("lineitem", "orders"):
        text = text.replace(f"<{name}>", name)
    return text.replace("{part}", "part")


def scripts(t):
    return t.sql(f"SELECT * FROM {SCRIPTS}", "part")


def jobs(t):
    return t.orders.select(F.concat(F.lit("job"), "o_orderkey").alias("job"))


def listing(t):
    """The stored artifacts, written once as the table that they would be."""
    t.lineitem.createOrReplaceTempView("stepframe_lineitem")
    made = t.spark.sql(f"SELECT * FROM {LISTING.replace('<lineitem>', 'stepframe_lineitem')}")
    return materialize(made, "listing")


STEPS_SQL = f"""
SELECT script_id, CAST(ordinal AS INTEGER) AS ordinal, lower(split_part(s, ' ', 1)) AS kind,
       nullif(lower(regexp_extract(s, '(?i)^proc ([a-z]+)', 1)), '') AS proc, s AS text
FROM (SELECT script_id, ordinal, trim(regexp_replace(piece, '\\s+', ' ', 'g')) AS s FROM (
  SELECT script_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) - 1 AS ordinal FROM (
    SELECT script_id, string_split(regexp_replace(regexp_replace(text, '(?s)/\\*.*?\\*/', ' ', 'g'),
             '(?i)(^|;)\\s*(data|proc)\\s', '\\1' || chr(1) || '\\2 ', 'g'), chr(1)) AS pieces
    FROM {_duck(SCRIPTS)})) WHERE ordinal > 0)"""


@query("script_step_inventory", STEPS_SQL)
def script_step_inventory(t):
    return C.script_step_inventory(scripts(t))


# The tables that the stand-in scripts are made of, not the rule that finds them.
EDGES_SQL = """
SELECT DISTINCT p_partkey AS script_id, src, dst FROM (
  SELECT p_partkey, 'lib.' || lower(p_type) AS src, 'work.d' || CAST(p_partkey AS VARCHAR) AS dst FROM part
  UNION ALL SELECT p_partkey, 'work.d', 'work.s' || CAST(p_size AS VARCHAR) FROM part WHERE p_size > 10
  UNION ALL SELECT p_partkey, src, dst FROM part JOIN (VALUES
    (20, 'work.s', 'm'), (20, 'lib.b', 'm'), (30, 'm', 't'), (30, 'lib.c', 't'), (40, 't', 'z'),
    (45, 'z', 'z'), (45, 'z', 'hist'), (45, 'f1', 'f'), (45, 'f2', 'f'), (45, 'g1', 'g'), (45, 't2', 't2'),
    (45, 'usa', 'u1'), (45, 'eu', 'u1'), (45, 'asia', 'u1'), (45, 'usa', 'u2'), (45, 'eu', 'u2'), (45, 'asia', 'u2')
  ) v(above, src, dst) ON p_size > above)"""


@query("script_lineage_edges", EDGES_SQL)
def script_lineage_edges(t):
    return C.script_lineage_edges(C.script_step_inventory(scripts(t)))


@query("script_macro_edges", """
SELECT p_partkey AS script_id, 'm' AS macro, 'defined' AS role FROM part WHERE p_type = 'LARGE' AND p_size < 25
UNION ALL SELECT p_partkey, 'clean', 'called' FROM part WHERE p_size > 45""")
def script_macro_edges(t):
    return C.script_macro_edges(scripts(t))


@query("script_dependency_count", f"""
SELECT script_id, COUNT(DISTINCT src) AS dependencies_count FROM ({EDGES_SQL}) GROUP BY script_id""")
def script_dependency_count(t):
    return C.script_dependency_count(C.script_lineage_edges(C.script_step_inventory(scripts(t))))


@query("script_upstream_tables", f"""
WITH RECURSIVE e AS ({EDGES_SQL}),
final AS (SELECT DISTINCT script_id, dst AS t FROM e
          WHERE (script_id, dst) NOT IN (SELECT (script_id, src) FROM e WHERE src <> dst)),
up AS (SELECT script_id, t, 0 AS depth FROM final
       UNION SELECT up.script_id, e.src, depth + 1 FROM up JOIN e ON e.script_id = up.script_id AND e.dst = up.t WHERE depth < 9)
SELECT script_id, t AS "table", CAST(MIN(depth) AS INTEGER) AS depth FROM up WHERE depth > 0 GROUP BY script_id, t""")
def script_upstream_tables(t):
    """All that the last tables of each script are made from, directly or not."""
    edges = materialize(C.script_lineage_edges(C.script_step_inventory(scripts(t))), "lineage")
    return C.upstream_tables(edges, C.final_tables(edges))


COMPLEXITY_SQL = f"""
SELECT script_id, CAST(n_steps AS INTEGER) AS n_steps, CAST(n_macros AS INTEGER) AS n_macros,
       CAST(n_advanced AS INTEGER) AS n_advanced,
       CAST(CASE WHEN n_advanced > 0 AND n_macros > 0 THEN 10 WHEN n_advanced > 0 THEN 9 WHEN n_macros >= 6 THEN 8
                 WHEN n_macros >= 3 THEN 7 ELSE greatest(1, least(6, n_steps)) END AS INTEGER) AS score,
       CASE WHEN n_advanced > 0 THEN 'advanced statistics' WHEN n_macros >= 3 THEN 'heavy macros'
            WHEN n_steps >= 4 THEN 'multiple steps' ELSE 'simple' END AS reason
FROM (SELECT script_id, len(regexp_extract_all(plain, '(?i)(^|;)\\s*(data|proc)\\s')) AS n_steps,
             len(regexp_extract_all(plain, '(?i)%(?:macro|let|if|do)\\b')) AS n_macros,
             len(regexp_extract_all(plain, '(?i)(^|;)\\s*proc\\s+(?:reg|glm|logistic|mixed)\\b')) AS n_advanced
      FROM (SELECT script_id, regexp_replace(text, '(?s)/\\*.*?\\*/', ' ', 'g') AS plain FROM {_duck(SCRIPTS)}))"""


@query("script_complexity", COMPLEXITY_SQL)
def script_complexity(t):
    return C.script_complexity(scripts(t))


@query("platform_decision", f"""
SELECT script_id, score, CASE WHEN score >= 6 OR (score = 5 AND (n_macros > 0 OR p_retailprice > 950))
                              THEN 'PySpark' ELSE 'SQL' END AS platform
FROM ({COMPLEXITY_SQL}) JOIN part ON p_partkey = script_id""")
def platform_decision(t):
    scored = C.script_complexity(scripts(t)).join(
        t.part.selectExpr("p_partkey AS script_id", "p_retailprice"), "script_id")
    return C.platform_decision(scored, F.col("p_retailprice") > 950).select("script_id", "score", "platform")


def _pick(column: str) -> str:
    digest = f"substr(md5('7|{column}|' || p_partkey), 1, 15)"
    return f"(CAST('0x' || {digest} AS BIGINT) % (SELECT COUNT(DISTINCT {column}) FROM part))"


def _even(column: str) -> str:
    return (f"(SELECT MIN({column}) FROM part) + (SELECT MAX({column}) - MIN({column}) FROM part) * {_pick(column)}"
            f" / (SELECT greatest(COUNT(DISTINCT {column}) - 1, 1) FROM part)")


@query("testdata_baseline", f"""
SELECT p_partkey, 'p_brand_' || {_pick('p_brand')} AS p_brand, 'p_type_' || {_pick('p_type')} AS p_type,
       CAST(floor({_even('p_size')}) AS INTEGER) AS p_size, round({_even('p_retailprice')}, 4) AS p_retailprice
FROM part""")
def testdata_baseline(t):
    made = X.testdata_baseline(t.part.select("p_partkey"), "p_partkey", t.part,
                               ["p_brand", "p_type", "p_size", "p_retailprice"], seed=7)
    return made.withColumn("p_retailprice", F.round("p_retailprice", 4))


@query("testdata_edges", f"""
SELECT column_name, unnest(['lowest', 'highest', 'missing', CASE WHEN mean IS NOT NULL THEN 'zero' ELSE 'blank' END]) AS edge,
       unnest([lowest, highest, NULL, CASE WHEN mean IS NOT NULL THEN '0' ELSE '' END]) AS value
FROM ({PROFILE_SQL})""")
def testdata_edges(t):
    return X.testdata_edges(order_profile(t))


@query("testdata_stress", """
SELECT p_partkey + copy * (SELECT MAX(p_partkey) - MIN(p_partkey) + 1 FROM part) AS p_partkey, p_brand, p_size, CAST(copy AS INTEGER) AS copy
FROM part, (SELECT unnest([0, 1, 2]) AS copy)""")
def testdata_stress(t):
    return X.testdata_stress(t.part.select("p_partkey", "p_brand", "p_size"), 3, ["p_partkey"])


EXPECTED_SQL = f"""
SELECT job, ext, unnest(['analyze_sas', 'decide_platform', 'translate_code', 'test_and_validate', 'review_and_approve']) AS task,
       unnest(['analysis.json', 'decision.json', job || '.' || ext, 'validation_report.json', 'final_approval.json']) AS file_name
FROM (SELECT j.job, CASE WHEN l.content = '{{"platform_choice": "PySpark"}}' THEN 'py' ELSE 'sql' END AS ext
      FROM {_duck(JOBS)} j LEFT JOIN {_duck(LISTING)} l ON l.job = j.job AND l.file_name = 'decision.json')"""
COMPLETE_SQL = f"""
SELECT e.job, e.task, e.ext, e.file_name, l.content, l.job IS NOT NULL AS present
FROM ({EXPECTED_SQL}) e LEFT JOIN {_duck(LISTING)} l
  ON l.job = e.job AND l.task = e.task AND l.file_name = e.file_name"""


@query("artifact_completeness", COMPLETE_SQL)
def artifact_completeness(t):
    return R.artifact_completeness(jobs(t), listing(t))


@query("job_verdict", f"""
SELECT job, COUNT(*) FILTER (present) AS n_present, bool_and(present) AS complete FROM ({COMPLETE_SQL}) GROUP BY job""")
def job_verdict(t):
    return R.job_verdict(R.artifact_completeness(jobs(t), listing(t), content=False))


@query("artifact_fallback", f"""
SELECT job, task, file_name, present OR fill AS present, fill AS is_fallback,
       CASE WHEN NOT fill THEN content WHEN task = 'test_and_validate' THEN 'SKIPPED'
            WHEN ext = 'py' THEN '# FALLBACK: Agent failed to generate translation'
            ELSE '-- FALLBACK: Agent failed to generate translation' END AS gist
FROM (SELECT *, NOT present AND task IN ('test_and_validate', 'translate_code') AS fill FROM ({COMPLETE_SQL}))""")
def artifact_fallback(t):
    filled = R.artifact_fallback(R.artifact_completeness(jobs(t), listing(t)))
    fallback = F.when(F.col("task") == "test_and_validate", F.get_json_object("content", "$.verdict"))
    gist = F.when(F.col("is_fallback"), fallback.otherwise(F.split_part("content", F.lit("\n"), F.lit(1))))
    return filled.select("job", "task", "file_name", "present", "is_fallback",
                         gist.otherwise(F.col("content")).alias("gist"))


@query("suffix_reconcile", f"""
WITH l AS (SELECT * FROM {_duck(LISTING)}),
     x AS (SELECT DISTINCT job, ext FROM ({EXPECTED_SQL}))
SELECT l.job, l.task, l.content,
       x.ext IS NOT NULL AND l.task = 'translate_code' AND l.file_name IN (l.job || '.sql', l.job || '.py')
         AND NOT EXISTS (SELECT 1 FROM l o WHERE o.job = l.job AND o.file_name = l.job || '.' || x.ext) AS renamed,
       CASE WHEN x.ext IS NOT NULL AND l.task = 'translate_code' AND l.file_name IN (l.job || '.sql', l.job || '.py')
             AND NOT EXISTS (SELECT 1 FROM l o WHERE o.job = l.job AND o.file_name = l.job || '.' || x.ext)
            THEN l.job || '.' || x.ext ELSE l.file_name END AS file_name
FROM l LEFT JOIN x ON x.job = l.job""")
def suffix_reconcile(t):
    return R.suffix_reconcile(jobs(t), listing(t))


@query("approval_rollup", """
WITH i AS (SELECT l_orderkey, COUNT(*) AS n_issues, COUNT(*) FILTER (l_quantity > 48) AS n_critical
           FROM lineitem WHERE l_quantity > 40 GROUP BY l_orderkey)
SELECT o_orderkey AS job, verdict, coalesce(n_issues, 0) AS n_issues, coalesce(n_critical, 0) AS n_critical,
       CASE WHEN n_critical > 0 THEN 'REJECTED' WHEN verdict = 'SKIPPED' THEN 'APPROVED_WITH_NOTES'
            ELSE 'APPROVED' END AS approval_status
FROM (SELECT *, CASE o_orderstatus WHEN 'O' THEN 'SKIPPED' WHEN 'P' THEN 'FAIL' ELSE 'PASS' END AS verdict FROM orders)
LEFT JOIN i ON l_orderkey = o_orderkey""")
def approval_rollup(t):
    status = F.col("o_orderstatus")
    verdicts = t.orders.select(F.col("o_orderkey").alias("job"), F.when(status == "O", "SKIPPED")
                               .when(status == "P", "FAIL").otherwise("PASS").alias("verdict"))
    severity = F.when(F.col("l_quantity") > 48, "critical").otherwise("minor").alias("severity")
    issues = t.lineitem.where("l_quantity > 40").select(F.col("l_orderkey").alias("job"), severity)
    return R.approval_rollup(verdicts, issues)


@query("context_bundle", """
SELECT source AS job, CASE lang WHEN 'en' THEN 'sas_analyst' WHEN 'fr' THEN 'platform_architect'
                           WHEN 'es' THEN 'code_translator' ELSE 'test_engineer' END AS agent,
       (rn - 1) // 10 AS page, COUNT(*) AS n_files,
       string_agg('=== ' || name || ' ===' || chr(10) || left(text, 2000), chr(10) || chr(10) ORDER BY name) AS bundle
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY source, lang ORDER BY name) AS rn FROM (
  SELECT *, 'f' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || CASE WHEN n_chars < 300 THEN '.log'
            WHEN n_chars < 800 THEN '.sql' ELSE '.json' END AS name FROM documents) WHERE n_chars >= 300)
GROUP BY source, agent, page""")
def context_bundle(t):
    lang = F.col("lang")
    suffix = F.when(F.col("n_chars") < 300, ".log").when(F.col("n_chars") < 800, ".sql").otherwise(".json")
    files = t.documents.select(
        F.col("source").alias("job"),
        F.when(lang == "en", "analyze_sas").when(lang == "fr", "decide_platform")
        .when(lang == "es", "translate_code").otherwise("test_and_validate").alias("task"),
        F.concat(F.lit("f"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), suffix).alias("file_name"),
        F.col("text").alias("content"))
    return R.context_bundle(files, page_size=10)


@query("log_line_parse", """
SELECT line, CASE WHEN ok THEN date_trunc('second', ts) END AS logged_at, CASE WHEN ok THEN 'agent_' || event_type END AS agent,
       CASE WHEN ok THEN '/out/jobs/' || user_id || '/tasks/' || event_type || '/' || event_id || '.json' END AS path,
       CASE WHEN ok THEN CAST(user_id AS VARCHAR) END AS job, CASE WHEN ok THEN event_type END AS step, ok AS parsed
FROM (SELECT *, event_type <> 'error' AS ok, CASE WHEN event_type = 'error' THEN 'disk full ' || event_id ELSE
  '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] [agent_' || event_type || '] Wrote: /out/jobs/' || user_id
  || '/tasks/' || event_type || '/' || event_id || '.json' END AS line FROM events)""")
def log_line_parse(t):
    good = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] [agent_"), "event_type",
                    F.lit("] Wrote: /out/jobs/"), "user_id", F.lit("/tasks/"), "event_type", F.lit("/"),
                    "event_id", F.lit(".json"))
    bad = F.concat(F.lit("disk full "), "event_id")
    lines = t.events.select(F.when(F.col("event_type") == "error", bad).otherwise(good).alias("line"))
    parsed = R.parse_log(lines)
    return parsed.withColumn("logged_at", F.col("logged_at").cast("timestamp_ntz"))
