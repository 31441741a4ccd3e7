"""Quality rules: measures of each text, and lines that too many documents of a host share.

Lines are normalised and hashed.  A line's count is the number of distinct documents of the host that
hold it; lines above the limit are removed, and a document that loses nearly all its words is
rejected.  Copies must not pass for boilerplate: equal texts are one document, and a line stays if
much of its documents are of one family, alike in their other lines as well (near copies).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepframe.llm.common import OWN, WORD, let, same, with_new, words

MIN_WORDS = 10
MAX_REPEATED = 20  # percent of the words
RUN = 5


def _neighbours(s: Column, i: Column) -> tuple[Column, Column]:
    """The elements before and after place ``i`` (from 0) of a sorted array; null at the ends."""
    return (F.when(i > 0, F.get(s, i - 1)), F.get(s, i + 1))


def _covered(hashes: Column) -> Column:
    """How many words lie in windows whose hash occurs twice, from the hashes of all windows in order.

    Windows are sorted by hash, the repeated ones by place; each covers the words up to the next one.
    """
    def repeated(s: Column) -> Column:
        def twice(x: Column, i: Column) -> Column:
            prev, after = _neighbours(s, i)
            return F.coalesce(prev["h"] == x["h"], F.lit(False)) | F.coalesce(after["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, twice), lambda x: x["at"]))

    def total(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.least(F.lit(RUN), F.coalesce(F.get(places, i + 1) - p, F.lit(RUN))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    by_hash = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    return let(let(by_hash, repeated), total)


def repeat_words(ws: Column) -> Column:
    """Words of the array that lie in five-word windows found twice or more, the first one included."""
    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _covered(hashes)).otherwise(F.lit(0).cast("long"))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (RUN - 1)), lambda i: F.xxhash64(F.slice(w, i, RUN)))

    return let(ws, lambda w: F.when(F.size(w) > RUN, let(windows(w), count)).otherwise(F.lit(0).cast("long")))


def measures(text: Column) -> Column:
    """A struct of counts for a text; all 0 for a null or empty one."""
    t = F.coalesce(text, F.lit(""))

    def of(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"),
                        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                        repeat_words(w).alias("n_repeat_words"))

    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return let(let(words(t), of), lambda m: F.struct(
        m["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        dup.alias("n_dup_lines"), m["n_repeat_words"].alias("n_repeat_words")))


def fails_base(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEATED)


def normal_line(line: Column) -> Column:
    """Lower case, digits as 0, white space as one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "), "[0-9]+", "0"))


def line_hash(line: Column) -> Column:
    return F.when(line.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(normal_line(line)))


def line_table(text: Column) -> Column:
    """For each line of a text in order the hash of its normal form, null if it has no word, and its words."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.struct(
        line_hash(x).alias("line"), F.regexp_count(x, F.lit(WORD)).alias("n")))


def least_run(line: Column) -> Column:
    """Least hash of the five-word runs of a normalised line; a shorter line is one run."""
    def least(ws: Column) -> Column:
        return F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - (RUN - 1), F.lit(1))),
                                       lambda i: F.xxhash64(F.slice(ws, i, RUN))))
    return let(F.split(line, " "), least)


def lines_with_family(text: Column, doc: Column) -> Column:
    """Distinct normalised lines (line, family) of a text.

    A line's family is the least run of the text's *other* lines, the document itself without any:
    near copies mostly agree in it, documents that have only this line in common don't.
    """
    def of(lines: Column) -> Column:
        def family(least: Column) -> Column:
            first, second = F.get(least, F.lit(0)), F.get(least, F.lit(1))
            return F.transform(lines, lambda x: F.struct(x["line"].alias("line"), F.coalesce(
                F.when(x["least"] == first, second).otherwise(first), doc).alias("family")))
        return let(F.sort_array(F.transform(lines, lambda x: x["least"])), family)

    told = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    lines = F.array_distinct(F.transform(F.transform(told, normal_line), lambda x: F.struct(
        F.xxhash64(x).alias("line"), least_run(x).alias("least"))))
    return let(lines, of)


def common_lines(lines: DataFrame, documents: DataFrame, min_documents: int, min_share: float, max_family: float) -> DataFrame:
    """Rows (host, line) of the lines above the limit, from distinct rows (host, doc, line, family) and (host, doc).

    The limit is ``min_documents``, or ``min_share`` of the host's distinct documents if that is more; a
    line of which one family has more than ``max_family`` of the documents belongs to a text that is
    copied and stays.  All counts are partial aggregates, so a line of all documents is no hot group.
    """
    families = lines.groupBy("host", "line", "family").agg(F.count("*").alias("n"))
    counted = families.groupBy("host", "line").agg(F.sum("n").alias("n"), F.max("n").alias("most")).filter(
        (F.col("n") > min_documents) & (F.col("most") <= F.col("n") * max_family))
    hosts = documents.groupBy("host").agg(F.count("*").alias("docs")).withColumnRenamed("host", "host_")
    return counted.join(hosts, same({"host": "host_"})).filter(
        F.col("n") > F.col("docs") * min_share).select("host", "line")


def quality_rules(docs: DataFrame, min_documents: int = 20, min_share: float = 0.0, min_left: float = 0.1,
                  max_family: float = 0.2, host: str = "source") -> DataFrame:
    """``docs`` with the counts of ``measures`` (long), ``base_failed``, ``clean_text``, ``removed_words`` and ``kept``.

    Needs ``text`` and the host column.  A document is kept if it passes the base rules (10 words or
    more, at most a fifth of them in repeated five-word runs) and if more than ``min_left`` of its
    words remain when the common lines are gone.  A line's limit is a number of documents, alike for hosts
    of every size, unless a ``min_share`` is given.  A null text has no words and fails, as does an empty
    one; its ``clean_text`` is what it was.  A null host is a host of its own.  Other columns go along
    whatever their names; equal rows get equal answers; an empty table stays empty.
    """
    names = ("host", "doc", "lines")
    base = docs.select("*", measures(F.col("text")).alias(OWN + "m"), *[c.alias(OWN + n) for n, c in zip(names, (
        F.col(host), F.xxhash64("text"), line_table(F.col("text"))))])
    documents = (docs.select(F.col(host).alias("host"), F.xxhash64("text").alias("doc"), lines_with_family(
        F.col("text"), F.xxhash64("text")).alias("lines")).dropDuplicates(["host", "doc"]))
    lines = documents.select("host", "doc", F.explode("lines").alias("x")).select("host", "doc", "x.line", "x.family")
    common = common_lines(lines, documents, min_documents, min_share, max_family).select(
        F.col("host").alias("host_"), F.col("line").alias("line_"))
    removed = (lines.join(common, same({"host": "host_", "line": "line_"})).groupBy("host", "doc")
               .agg(F.collect_set("line").alias("gone"))
               .select(*[F.col(n).alias(f"{OWN}{n}_") for n in ("host", "doc", "gone")]))
    joined = base.join(removed, same({OWN + "host": OWN + "host_", OWN + "doc": OWN + "doc_"}), "left")
    m, gone, text = F.col(OWN + "m"), F.col(OWN + "gone_"), F.col("text")
    n_gone = F.when(gone.isNull(), F.lit(0).cast("long")).otherwise(F.aggregate(
        OWN + "lines", F.lit(0).cast("long"),
        lambda a, x: a + F.when(F.array_contains(gone, x["line"]), x["n"].cast("long")).otherwise(F.lit(0).cast("long"))))
    stay = F.filter(F.split(text, "\n"), lambda x, i: ~F.coalesce(
        F.array_contains(gone, F.get(F.col(OWN + "lines"), i)["line"]), F.lit(False)))
    counts = {n: m[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    failed = fails_base(m)
    return with_new(joined, **counts, base_failed=failed,
                    clean_text=F.when(gone.isNull(), text).otherwise(F.array_join(stay, "\n")), removed_words=n_gone,
                    kept=~failed & (m["n_words"] - n_gone > m["n_words"] * min_left))
