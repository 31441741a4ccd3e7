"""Ranges of an order: cut points that share rows out evenly, and numbering inside them.

A table is numbered without a copy of it.  Cut points come from a bounded sample of the order
columns, chosen by a hash, and are stored; rows per range are counted; each row's number is its
place in its range plus the rows of the ranges before.  Only order columns are read for the first
two steps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepframe.session import materialize

#: Rows that one task numbers, and the most ranges; beyond it ranges grow and their sort spills.
ROWS_PER_RANGE, MAX_RANGES = 500_000, 16_384
#: Sampled keys for each range.
SAMPLED = 16
RANGE = "_sf_range"


def _key(order_by: Sequence[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(order_by)])


def order_cuts(df: DataFrame, order_by: Sequence[str], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame | None:
    """One stored row ``cuts``: an ascending array of order keys; None if one range holds all rows.

    The sample takes keys whose hash is below a bound, each key once, so a key that very many rows
    have does not crowd out the others.  About ``SAMPLED`` keys per range, however many rows there are.
    """
    rows = df.count()
    ranges = min(MAX_RANGES, -(-rows // rows_per_range))
    if ranges <= 1:
        return None
    bound = min(1 << 30, -(-ranges * SAMPLED * (1 << 30) // rows))
    keys = df.select(_key(order_by).alias("key"))
    keys = keys.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < bound).distinct()
    keys = keys.agg(F.sort_array(F.collect_list("key")).alias("keys"))
    step = F.size("keys") / F.lit(float(ranges))
    at = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.get("keys", F.floor(i * step).cast("int")))
    return materialize(keys.select(F.array_distinct(F.filter(at, lambda k: k.isNotNull())).alias("cuts")), "cuts")


def with_range(df: DataFrame, order_by: Sequence[str], cuts: DataFrame | None) -> DataFrame:
    """Each row with the number of cuts at or below its key, found by halves."""
    if cuts is None:
        return df.withColumn(RANGE, F.lit(0))
    halves = F.array(*[F.lit(1 << b) for b in reversed(range(MAX_RANGES.bit_length()))])
    keyed = df.withColumns({"_sf_key": _key(order_by), "_sf_cuts": cuts.scalar()})
    found = F.aggregate(halves, F.lit(0), lambda low, step: F.when(
        F.get("_sf_cuts", low + step - 1) <= F.col("_sf_key"), low + step).otherwise(low))
    return keyed.withColumn(RANGE, found).drop("_sf_key", "_sf_cuts")


def total_order(df: DataFrame, order_by: Sequence[str]) -> list[Column]:
    """The order columns, then a hash of all columns: only rows that agree in it may change places in a second run."""
    hashed = [f"`{f.name}`" for f in df.schema.fields if "map<" not in f.dataType.simpleString()
              and "variant" not in f.dataType.simpleString()]
    return [*[F.col(f"`{c}`") for c in order_by], F.xxhash64(*hashed)]


def numbered_by_ranges(df: DataFrame, order_by: Sequence[str], out: str, number_hot,
                       rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Numbers from 1 in the order, rows that agree in it by their hash.

    Cuts can't divide rows with one and the same key.  A range that has over eight times the rows it
    should have is numbered by ``number_hot(rows, by, order, out)``, which has to keep its order when
    a task is run again.
    """
    df = df.drop(out)
    cuts = order_cuts(df, order_by, rows_per_range)
    order = total_order(df, order_by)
    ranged = with_range(df, order_by, cuts)
    place = F.row_number().over(Window.partitionBy(RANGE).orderBy(*order)).cast("bigint")
    if cuts is None:
        return ranged.withColumn(out, place).drop(RANGE)
    counts = ranged.groupBy(RANGE).agg(F.count(F.lit(1)).alias("_sf_rows"))
    before = Window.partitionBy(F.lit(0)).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    # At most MAX_RANGES rows; stored, so that all uses of it agree and Spark knows its size.
    counts = materialize(counts.withColumn("_sf_before", F.coalesce(F.sum("_sf_rows").over(before), F.lit(0))), "ranges")
    hot = counts.where(F.col("_sf_rows") > 8 * rows_per_range).select(RANGE)
    if hot.isEmpty():
        numbered = ranged.withColumn(out, place)
    else:
        numbered = ranged.join(hot, RANGE, "left_anti").withColumn(out, place).unionByName(
            number_hot(ranged.join(hot, RANGE, "left_semi"), [RANGE], order, out))
    numbered = numbered.join(counts, RANGE).withColumn(out, F.col(out) + F.col("_sf_before"))
    return numbered.select(*[F.col(f"`{c}`") for c in [*df.columns, out]])
