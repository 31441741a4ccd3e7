"""Summaries: class means with overall rows, frequencies, profiles, rates and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepframe.functions.missing import plain_text


# Statistics that can be put together from those of the finest classes: partial aggregates per
# class, and the statistic from the partials of several classes.
_PARTIALS = {
    "n": ({"n": F.count}, lambda p: F.sum(p["n"])),
    "sum": ({"sum": F.sum}, lambda p: F.sum(p["sum"])),
    "mean": ({"sum": F.sum, "n": F.count}, lambda p: F.sum(p["sum"]) / F.nullif(F.sum(p["n"]), F.lit(0))),
    "min": ({"min": F.min}, lambda p: F.min(p["min"])),
    "max": ({"max": F.max}, lambda p: F.max(p["max"])),
}


def class_means(df: DataFrame, classes: Sequence[str], stats: dict[str, Column | tuple[str, str]],
                nway: bool = False, types: Sequence[int] | None = None,
                include_missing: bool = False) -> DataFrame:
    """Statistics per class level and for all coarser combinations down to the overall row.

    ``stats`` maps an output to (statistic, column) with statistic one of n, sum, mean, min, max,
    or to any aggregate Column.  Adds ``_TYPE_`` (a bit is set for each class variable in use,
    the last one is bit 0) and ``_FREQ_`` (rows of the group).  Rows with a missing class level
    count nowhere unless ``include_missing``.  ``nway`` keeps the finest combination only;
    ``types`` picks combinations, so rows are not expanded for the ones not asked for.

    With named statistics the rows are reduced to the finest classes first, and only these few
    are expanded to the coarser combinations; aggregate Columns expand the rows themselves.
    A table without rows gives no rows.
    """
    k = len(classes)
    full = (1 << k) - 1
    df = plain_text(df, classes)
    if not include_missing:
        df = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in classes]))
    named = all(isinstance(s, tuple) for s in stats.values())
    rows = F.count(F.lit(1))
    if named:
        needed = {(part, column): make for name, column in stats.values()
                  for part, make in _PARTIALS[name][0].items()}
        at = {key: f"_sf_{i}" for i, key in enumerate(needed)}
        df = df.groupBy(*classes).agg(rows.alias("_sf_rows"), *[
            make(column).alias(at[part, column]) for (part, column), make in needed.items()])
        rows = F.sum("_sf_rows")
        stats = {out: _PARTIALS[name][1]({part: at[part, column] for part in _PARTIALS[name][0]})
                 for out, (name, column) in stats.items()}
    aggs = [rows.cast("bigint").alias("_FREQ_"), *[s.alias(o) for o, s in stats.items()]]
    if nway:
        out = df.groupBy(*classes).agg(*aggs).withColumn("_TYPE_", F.lit(full))
    else:
        wanted = range(full + 1) if types is None else types
        sets = [[F.col(c) for i, c in enumerate(classes) if t >> (k - 1 - i) & 1] for t in wanted]
        kind = (F.lit(full) - F.grouping_id()).cast("int").alias("_TYPE_")
        out = df.groupingSets(sets, *classes).agg(kind, *aggs)
    return out.select(*classes, "_TYPE_", "_FREQ_", *stats)


def overall_means(df: DataFrame, stats: dict[str, Column]) -> DataFrame:
    """One row of statistics over the whole table."""
    return df.agg(*[s.alias(o) for o, s in stats.items()])


def freq_oneway(df: DataFrame, column: str, include_missing: bool = False) -> DataFrame:
    """COUNT and PERCENT per level.

    A missing level is listed, but it is not part of the percent base and has no percent
    unless ``include_missing``.  The total is a scalar subquery over the counts, whose shuffle
    both share: the table is read once, and there is no unpartitioned window.
    """
    counts = plain_text(df, [column]).groupBy(column).agg(F.count(F.lit(1)).cast("bigint").alias("COUNT"))
    base = F.lit(True) if include_missing else F.col(column).isNotNull()
    total = counts.select(F.sum(F.when(base, F.col("COUNT")))).scalar()
    percent = F.col("COUNT") * F.lit(100.0) / total
    if not include_missing:
        percent = F.when(F.col(column).isNotNull(), percent)
    return counts.withColumn("PERCENT", percent)


def progress_percent(tasks: DataFrame, by: Sequence[str], processed: Column) -> DataFrame:
    """Whole percent of processed tasks per group, rounded down."""
    done = F.count(F.when(processed, 1))
    total = F.count(F.lit(1))
    return tasks.groupBy(*by).agg(
        total.cast("bigint").alias("total_tasks"), done.cast("bigint").alias("processed_tasks"),
        F.floor(done * 100 / total).cast("int").alias("progress"))


def conversion_time_stats(tasks: DataFrame, by: Sequence[str], started: str, completed: str,
                          stats: dict[str, Column] | None = None) -> DataFrame:
    """Finished tasks, mean seconds from start to completion, and further statistics."""
    took = F.col(completed) - F.col(started)
    # Taken from the interval, so the session time zone plays no part.
    seconds = sum((F.extract(F.lit(unit), took) * n for unit, n in
                   (("DAY", 86400), ("HOUR", 3600), ("MINUTE", 60))),
                  F.extract(F.lit("SECOND"), took)).cast("double")
    aggs = [F.count(seconds).cast("bigint").alias("files_converted"),
            F.avg(seconds).alias("avg_conversion_seconds")]
    return tasks.groupBy(*by).agg(*aggs, *[s.alias(o) for o, s in (stats or {}).items()])


def return_code_rollup(codes: DataFrame, job: str, step: str, code: str) -> DataFrame:
    """Highest code per step and per job in one pass (``level`` is 'step' or 'job')."""
    rolled = codes.groupingSets([[F.col(job), F.col(step)], [F.col(job)]], job, step).agg(
        F.grouping(step).alias("_sf_total"), F.max(code).alias("rc"))
    level = F.when(F.col("_sf_total") == 1, F.lit("job")).otherwise(F.lit("step"))
    return rolled.select(job, step, level.alias("level"), "rc")


def column_profile(df: DataFrame, columns: Sequence[str] | None = None,
                   exact: bool | Sequence[str] = True) -> DataFrame:
    """One row per column: rows, nulls, distinct values, lowest, highest, mean.

    Lowest and highest are text; the mean is missing for text columns.  Distinct values are
    counted exactly, which costs a second pass that repeats each row once per column; with ``exact`` False, or
    for columns that it doesn't name, by a sketch of fixed size in the one pass over the table, within about 5 %.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    precise = {f.name for f in fields} if exact is True else set(exact or ())
    entries, aggs, distincts = [], [F.count(F.lit(1)).alias("_sf_rows")], []
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        mean = F.avg(c) if isinstance(f.dataType, T.NumericType) else F.lit(None).cast("double")
        aggs += [F.count(c).alias(f"_sf_n{i}"), F.min(c).alias(f"_sf_lo{i}"),
                 F.max(c).alias(f"_sf_hi{i}"), mean.cast("double").alias(f"_sf_m{i}")]
        if f.name in precise:
            distincts.append(F.count_distinct(c).alias(f"d{i}"))
        else:
            aggs.append(F.approx_count_distinct(c).alias(f"_sf_u{i}"))
        n_distinct = F.col(f"_sf_d.d{i}" if f.name in precise else f"_sf_u{i}")
        entries.append(F.struct(
            F.lit(f.name).alias("column_name"), F.col("_sf_rows").alias("n_rows"),
            (F.col("_sf_rows") - F.col(f"_sf_n{i}")).alias("n_missing"),
            n_distinct.cast("bigint").alias("n_distinct"),
            F.col(f"_sf_lo{i}").cast("string").alias("lowest"),
            F.col(f"_sf_hi{i}").cast("string").alias("highest"),
            F.col(f"_sf_m{i}").alias("mean")))
    one_row = df.agg(*aggs)
    if distincts:
        # Apart from the texts' lowest and highest values the exact counts stay hash aggregates,
        # where together all expanded rows would be sorted.
        one_row = one_row.withColumn("_sf_d", df.agg(F.struct(*distincts).alias("d")).scalar())
    # One row goes in, one row per column comes out.
    return one_row.select(F.inline(F.array(*entries)))


def count_by(df: DataFrame, by: Sequence[str], out: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).cast("bigint").alias(out))


def class_types(k: int, ways: int) -> list[int]:
    """The ``_TYPE_`` numbers of all combinations of ``ways`` out of ``k`` class variables."""
    return [sum(1 << (k - 1 - i) for i in pick) for pick in combinations(range(k), ways)]
