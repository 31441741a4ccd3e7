"""Inventory of a corpus of legacy scripts: steps, table lineage, complexity, platform.

The corpus is a table (script_id, text); each script is one row and is never split over rows
before its steps are known, so all work is row-local until edges are counted.  The rules are
patterns over whole texts, not a language parser: a step starts where a statement begins
with ``data`` or ``proc`` and lasts until the next one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepframe.session import Rounds, materialize

COMMENT = r"(?s)/\*.*?\*/"
STEP_START = r"(?i)(^|;)\s*(data|proc)\s"
NAME = r"([A-Za-z_][A-Za-z0-9_.]*)"
QUOTED = r"'[^']*'|\"[^\"]*\""
OPTIONS = r"\([^()]*\)"
MACRO = r"(?i)%(?:macro|let|if|do)\b"
# Fixed list (ours): procedures that count as advanced statistics.
ADVANCED = ("reg", "glm", "logistic", "mixed", "arima", "genmod", "nlin", "phreg", "varclus")
# Fixed list: words of the macro language that call no macro.
MACRO_WORDS = ("macro mend let if then else do to by end while until global local put include eval sysevalf sysfunc "
               "qsysfunc str nrstr quote bquote nrbquote superq scan upcase lowcase substr length index return goto abort "
               "sysexec sysget symdel").split()
_MARK = "\u0001"


def script_step_inventory(scripts: DataFrame, text: str = "text") -> DataFrame:
    """One row per step: (script_id, ordinal from 1, kind, proc, text)."""
    plain = F.regexp_replace(F.col(text), COMMENT, " ")
    marked = F.regexp_replace(plain, STEP_START, rf"$1{_MARK}$2 ")
    pieces = scripts.select("script_id", F.posexplode(F.split(marked, _MARK)).alias("ordinal", "s"))
    steps = pieces.where("ordinal > 0").withColumn("s", F.trim(F.regexp_replace("s", r"\s+", " ")))
    kind = F.lower(F.split_part("s", F.lit(" "), F.lit(1)))
    proc = F.lower(F.regexp_extract("s", r"(?i)^proc ([a-z]+)", 1))
    return steps.select("script_id", "ordinal", kind.alias("kind"),
                        F.nullif(proc, F.lit("")).alias("proc"), F.col("s").alias("text"))


def _listed(text: Column) -> Column:
    """Table names of a list such as ``a(in=x) b end=last``, in lower case: without options of either kind."""
    bare = F.regexp_replace(F.regexp_replace(text, OPTIONS, " "), r"[A-Za-z_]\w*\s*=\s*[^\s;]+", " ")
    return F.transform(F.regexp_extract_all(F.split_part(bare, F.lit("/"), F.lit(1)), F.lit(NAME), F.lit(1)), F.lower)


def _named(statement: Column, pattern: str) -> Column:
    """Names that the pattern's group catches, in lower case."""
    return F.transform(F.regexp_extract_all(statement, F.lit(pattern), F.lit(1)), F.lower)


def _from_lists(statement: Column) -> Column:
    """Tables of FROM lists and joins: the first name of each part between commas."""
    lists = F.regexp_extract_all(statement, F.lit(
        r"(?i)\b(?:from|join)\s+([^();]*?)(?=\bwhere\b|\bgroup\b|\border\b|\bhaving\b|\bon\b|\bleft\b|\bright\b"
        r"|\binner\b|\bfull\b|\bcross\b|\bnatural\b|\bjoin\b|\bunion\b|[()]|$)"), F.lit(1))
    first = F.transform(F.flatten(F.transform(lists, lambda x: F.split(x, ","))),
                        lambda x: F.lower(F.regexp_extract(x, rf"^\s*{NAME}", 1)))
    return F.filter(first, lambda x: x != "")


def script_lineage_edges(steps: DataFrame) -> DataFrame:
    """Distinct (script_id, src, dst): tables that are read and the tables made from them.

    In PROC SQL source and target belong to one statement, elsewhere to one step.  Lists of SET,
    MERGE and FROM count in full.  A sort without OUT, UPDATE and DELETE write what they read; an
    append writes its base.
    """
    bare = F.regexp_replace("text", QUOTED, " ")
    statements = F.transform(F.split(bare, ";"), lambda x: F.trim(x))
    is_sql = F.coalesce(F.col("proc") == "sql", F.lit(False))
    units = steps.select("script_id", "kind", "proc", F.explode(F.when(is_sql, statements).otherwise(F.array(bare))).alias("s"))
    s = F.col("s")
    own = _named(s, rf"(?i)^(?:update|delete\s+from)\s+{NAME}")
    made = F.concat(_named(s, rf"(?i)\bcreate\s+(?:table|view)\s+{NAME}"), _named(s, rf"(?i)^insert\s+into\s+{NAME}"))
    data_out = _listed(F.regexp_extract(s, r"(?i)^data\s+([^;]*)", 1))
    data_in = F.flatten(F.transform(F.regexp_extract_all(s, F.lit(r"(?i);\s*(?:set|merge|update|modify)\s+([^;]*)"), F.lit(1)), _listed))
    read, out = _named(s, rf"(?i)\bdata\s*=\s*{NAME}"), _named(s, rf"(?i)\bout\s*=\s*{NAME}")
    in_place = (F.col("proc") == "sort") & (F.size(out) == 0)
    is_data = F.col("kind") == "data"
    srcs = F.when(is_data, data_in).when(is_sql, F.concat(own, F.when(F.size(own) > 0, F.array()).otherwise(_from_lists(s)))).otherwise(read)
    dsts = (F.when(is_data, F.filter(data_out, lambda x: x != "_null_")).when(is_sql, F.concat(own, made)).when(in_place, read)
            .when(F.col("proc") == "append", _named(s, rf"(?i)\bbase\s*=\s*{NAME}")).otherwise(out))
    one = units.select("script_id", dsts.alias("dsts"), F.explode(srcs).alias("src"))
    return one.select("script_id", "src", F.explode("dsts").alias("dst")).distinct()


def script_macro_edges(scripts: DataFrame, text: str = "text") -> DataFrame:
    """Distinct (script_id, macro, role): macros that a script defines and those that it calls."""
    plain = F.regexp_replace(F.regexp_replace(F.col(text), COMMENT, " "), r"'[^']*'", " ")
    defined = _named(plain, r"(?i)%macro\s+([A-Za-z_]\w*)")
    called = F.filter(_named(plain, r"%([A-Za-z_]\w*)"), lambda x: ~x.isin(MACRO_WORDS))
    pairs = F.concat(F.transform(defined, lambda m: F.struct(m.alias("macro"), F.lit("defined").alias("role"))),
                     F.transform(called, lambda m: F.struct(m.alias("macro"), F.lit("called").alias("role"))))
    return scripts.select("script_id", F.inline(pairs)).distinct()


def script_dependency_count(edges: DataFrame, by: Sequence[str] = ("script_id",)) -> DataFrame:
    """Distinct upstream tables per script or per any coarser grouping."""
    return edges.groupBy(*by).agg(F.count_distinct("src").alias("dependencies_count"))


def final_tables(edges: DataFrame, by: Sequence[str] = ("script_id",)) -> DataFrame:
    """Distinct (by, table): tables that are made and that no other table is made from."""
    used = edges.where("src <> dst").select(*by, F.col("src").alias("table"))
    return edges.select(*by, F.col("dst").alias("table")).distinct().join(used, [*by, "table"], "left_anti")


def upstream_tables(edges: DataFrame, tables: DataFrame, by: Sequence[str] = ("script_id",)) -> DataFrame:
    """Distinct (by, table, depth): all that the given (by, table) are made from, through any number of steps.

    ``depth`` is the least number of steps to one of them.  Edges (by, src, dst) lead on inside a group of ``by``;
    without ``by`` through all scripts.  Each turn goes one step back from what the last one found first, so a cycle
    ends, and a table that is part of one is upstream of itself.  Turns are stored; one reads all before as one table.
    """
    by = list(by)
    steps = materialize(edges.select(*by, "src", "dst").distinct(), "edges")
    found, depth = Rounds(edges.sparkSession, "upstream"), 1
    front = tables.select(*by, "table").distinct()
    while True:
        back = front.withColumnRenamed("table", "dst").join(steps, [*by, "dst"]).select(*by, F.col("src").alias("table")).distinct()
        if found.n:
            back = back.join(found.all().select(*by, "table"), [*by, "table"], "left_anti")
        front = found.add(back.withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return found.all()
        depth += 1


def script_complexity(scripts: DataFrame, text: str = "text") -> DataFrame:
    """Score 1-10 per script with the features behind it.

    Advanced statistics give 9, or 10 with macros; otherwise three macro statements or more
    give 7, or 8 from six on; otherwise 1-3 for up to three steps and 4-6 for four to six and
    more.
    """
    plain = F.regexp_replace(F.col(text), COMMENT, " ")
    n_steps = F.regexp_count(plain, F.lit(STEP_START))
    n_macros = F.regexp_count(plain, F.lit(MACRO))
    advanced = rf"(?i)(^|;)\s*proc\s+(?:{'|'.join(ADVANCED)})\b"
    rows = scripts.select("script_id", n_steps.alias("n_steps"), n_macros.alias("n_macros"),
                          F.regexp_count(plain, F.lit(advanced)).alias("n_advanced"))
    score = (F.when((F.col("n_advanced") > 0) & (F.col("n_macros") > 0), F.lit(10))
             .when(F.col("n_advanced") > 0, F.lit(9))
             .when(F.col("n_macros") >= 6, F.lit(8))
             .when(F.col("n_macros") >= 3, F.lit(7))
             .otherwise(F.greatest(F.lit(1), F.least(F.lit(6), F.col("n_steps")))))
    reason = (F.when(F.col("n_advanced") > 0, F.lit("advanced statistics"))
              .when(F.col("n_macros") >= 3, F.lit("heavy macros"))
              .when(F.col("n_steps") >= 4, F.lit("multiple steps"))
              .otherwise(F.lit("simple")))
    return rows.withColumns({"score": score.cast("int"), "reason": reason})


def platform_decision(scored: DataFrame, large_data: Column | None = None) -> DataFrame:
    """SQL up to score 4, PySpark from 6; at 5 PySpark only with macros or large data."""
    heavy = F.col("n_macros") > 0
    if large_data is not None:
        heavy = heavy | F.coalesce(large_data, F.lit(False))
    pyspark = (F.col("score") >= 6) | ((F.col("score") == 5) & heavy)
    return scored.withColumn("platform", F.when(pyspark, F.lit("PySpark")).otherwise(F.lit("SQL")))
