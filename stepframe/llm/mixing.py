"""Mixing sources to target weights by Pareto order sampling.

Each document first gets the whole copies that are certain.  For the rest of a source's target its
documents have inclusion probabilities proportional to their sizes; they are ranked by random odds over
inclusion odds, and the first ones get one copy more until the words that are left are used up: a sample
of fixed size in words.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stepframe.llm.common import OWN, same, with_new
from stepframe.session import materialize

WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = 3) -> DataFrame:
    """Targets per source from rows (source, source_size), one row per source.

    Sources in code-point order, null last, have the weights in turn.  All sizes together are shared
    by weight; a target stops at ``cap`` times the source's size and the excess is shared again.  In
    ascending order of cap over weight, a source is capped if its share of what the capped ones
    before it left would pass its cap; all others share the rest, so one pass settles it.  The window
    holds one row per source, not documents.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = sizes.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * cap).alias("most"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = ranked.select("*", (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(earlier), F.lit(0))).alias("words"),
                         (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))).alias("shares"))
    capped = left.select("*", (F.col("most") * F.col("shares") <= F.col("words") * F.col("weight")).alias("capped"))
    free = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(whole)
    rest = F.sum("source_size").over(whole) - F.sum(F.when(F.col("capped"), F.col("most")).otherwise(F.lit(0))).over(whole)
    return capped.select("source", "source_size", "weight", F.when(F.col("capped"), F.col("most").cast("double"))
                         .otherwise(rest.cast("double") / free.cast("double") * F.col("weight").cast("double")).alias("target"))


def uniform(seed: int, *identity: Column) -> Column:
    """A number between 0 and 1, both left out, that depends on the seed and the texts alone."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in identity]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(2.0 ** 52)


def inclusion(sizes: DataFrame, wanted: Column) -> DataFrame:
    """Rows (source, certain_size, certain_words, per_word) from rows (source, size, rows, ...) and the words wanted of each source.

    A document's inclusion probability is ``per_word`` times its size, so that the expected words are those
    wanted.  Where that would pass 1 a document is certain: those of ``certain_size`` words or more, which take
    ``certain_words`` of the words.  From the largest size down, a size is certain if its share of what the larger ones leave
    reaches 1; once one is not, no smaller one is.  The window holds a row per source and size, not documents.
    """
    down = Window.partitionBy("source").orderBy(F.col("size").desc())
    squares = (F.col("size").cast("decimal(10,0)") * F.col("size").cast("decimal(10,0)") * F.col("rows").cast("decimal(16,0)")).cast("decimal(38,0)")
    ranked = sizes.select("source", "size", (F.col("size") * F.col("rows")).alias("words"), squares.alias("squares"), wanted.alias("wanted"))
    larger = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    others = F.sum("squares").over(down.rowsBetween(0, Window.unboundedFollowing))
    certain = (F.col("size") > 0) & ((F.col("wanted") - larger) * F.col("size") >= others.cast("double"))
    marked = ranked.withColumn("certain", certain)
    return marked.groupBy("source").agg(
        F.min(F.when(F.col("certain"), F.col("size"))).alias("certain_size"),
        F.coalesce(F.sum(F.when(F.col("certain"), F.col("words"))), F.lit(0)).alias("certain_words"),
        F.sum(F.when(~F.col("certain"), F.col("squares"))).cast("double").alias("squares"), F.max("wanted").alias("wanted")).select(
        "source", "certain_size", "certain_words",
        F.when(F.col("squares") > 0, (F.col("wanted") - F.col("certain_words")) / F.col("squares")).otherwise(F.lit(0.0)).alias("per_word"))


def mix_plan(rows: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = 3, block_rows: int = 5_000) -> DataFrame:
    """Copies for rows (source, doc_id, size, u), one per distinct row.

    Returns these columns with ``rows`` (how many equal rows there were), ``source_size``, ``target``,
    ``sure`` (copies each of them gets) and ``extra`` (how many of them get one more).

    What a target has beyond whole copies of the source is drawn with probabilities proportional to size (``inclusion``): certain
    documents get one more sure copy, the others are ranked by the odds of their draw over the odds of their inclusion, and the first
    ones are taken until the words are used up.  Documents without words are never drawn.

    Ranks are found in blocks, so a source with most of the rows is spread over many tasks; words before a block come from the blocks'
    sums.  Blocks are even in the logarithm of the rank: there a draw's odds have density a quarter at most, wherever a document's
    inclusion puts it, so a block of width ``4 / blocks`` is expected to hold at most one in ``blocks`` rows, whatever the sizes are.
    """
    counted = materialize(rows.groupBy("source", "doc_id", "size", "u").agg(F.count("*").alias("rows")), "mix")
    sizes = counted.groupBy("source", "size").agg(F.sum("rows").alias("rows"))
    blocks = max(1, math.ceil((counted.agg(F.sum("rows")).first()[0] or 0) / block_rows))
    targets = source_targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")), weights, cap)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # A share within rounding of a whole number leaves nothing to sample.
    targets = targets.select("source", "source_size", "target", F.floor(share).cast("long").alias("whole"),
                             (F.col("target") - F.floor(share) * F.col("source_size")).alias("wanted"),
                             ((share > F.floor(share)) & (F.floor(share) < cap)).alias("drawn"))
    drawn = targets.filter("drawn").select(F.col("source").alias("source_"), "wanted")
    chances = inclusion(sizes.join(drawn, same({"source": "source_"})), F.col("wanted"))
    targets = targets.join(chances.withColumnRenamed("source", "source_"), same({"source": "source_"}), "left").drop("source_")
    # Stored, so that it is made once and joined by its real size: a row per source.
    targets = materialize(targets, "mix-targets")
    ranked = counted.join(targets, counted["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    certain = F.coalesce(F.col("drawn") & (F.col("size") >= F.col("certain_size")), F.lit(False))
    chance = F.col("per_word") * F.col("size")
    # Rounding may put a document that is not certain on 1.
    odds = F.when(F.col("drawn") & ~F.col("certain") & (chance > 0), chance / F.greatest(1 - chance, F.lit(2.0 ** -53)))
    ranked = (ranked.withColumn("certain", certain).withColumn("sure", F.col("whole") + F.col("certain").cast("long"))
              .withColumn("rank", F.col("u") / (1 - F.col("u")) / odds)
              .withColumn("block", F.floor(F.ln("rank") * F.lit(blocks / 4))))
    fixed, open_ = ranked.filter(F.col("rank").isNull()), ranked.filter(F.col("rank").isNotNull())
    words = F.col("size") * F.col("rows")
    inside = Window.partitionBy("source", "block").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = open_.groupBy("source", "block").agg(F.sum(words).alias("words")).select(
        F.col("source").alias("source_"), F.col("block").alias("block_"),
        F.coalesce(F.sum("words").over(before), F.lit(0)).alias("begin"))
    placed = open_.withColumn("inside", F.coalesce(F.sum(words).over(inside), F.lit(0))).join(
        begins, F.col("source").eqNullSafe(F.col("source_")) & (F.col("block") == F.col("block_")))
    # The k-th of equal rows is taken if half of it still fits: 2 (cum + (k - 1) size) + size <= 2 wanted.
    left = F.col("wanted") - F.col("certain_words") - (F.col("begin") + F.col("inside"))
    fits = F.floor(left / F.col("size") + F.lit(0.5))
    given = ("source", "doc_id", "size", "u", "rows", "source_size", "target", "sure")
    return placed.select(*given, F.greatest(F.lit(0), F.least(fits, F.col("rows"))).cast("long").alias("extra")).unionByName(
        fixed.select(*given, F.lit(0).cast("long").alias("extra")))


def mix_sources(docs: DataFrame, size: Column, seed: int = 0, weights: Sequence[int] = WEIGHTS, cap: int = 3) -> DataFrame:
    """Documents repeated as often as the mix takes them; documents that it does not take are gone.

    Needs ``doc_id``, ``text`` and ``source``; other columns go along whatever their names.  Rows that
    are equal in id, text and source share their draw; a part of them may be taken.  A null source is
    a source of its own, null and empty texts have size 0, an empty table stays empty, a table whose
    sizes are all 0 has targets 0 and is dropped.  Draws hang on the seed, id and text alone, so
    reruns and retried tasks agree.
    """
    names = ("source", "doc_id", "size", "u")
    keyed = docs.select("*", *[c.alias(OWN + n) for n, c in zip(names, (
        F.col("source"), F.col("doc_id"), size, uniform(seed, F.col("doc_id"), F.col("text"))))])
    plan = mix_plan(keyed.select(*[F.col(OWN + n).alias(n) for n in names]), weights, cap)
    own = plan.select(*[F.col(n).alias(f"{OWN}plan_{n}") for n in plan.columns])
    joined = keyed.join(own, same({OWN + n: f"{OWN}plan_{n}" for n in names}))
    # Only where part of some equal rows is taken do they have to be told apart: once per source at most.
    sure, extra, rows = (F.col(f"{OWN}plan_{n}") for n in ("sure", "extra", "rows"))
    part = (extra > 0) & (extra < rows)
    nth = F.row_number().over(Window.partitionBy(*[OWN + n for n in names]).orderBy(OWN + "doc_id"))
    taken = joined.filter(~part).withColumn(OWN + "nth", F.lit(1)).unionByName(
        joined.filter(part).withColumn(OWN + "nth", nth))
    copies = sure + F.when(F.col(OWN + "nth") <= extra, F.lit(1)).otherwise(F.lit(0))
    repeated = taken.withColumn(OWN + "copies", copies).filter(F.col(OWN + "copies") > 0)
    return with_new(repeated.withColumn(OWN + "copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(OWN + "copies")))))
