"""Stacking tables and comparing two versions of a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepframe.operators.ordered import _sized, positions


def set_concat(tables: Sequence[DataFrame], source_index: str | None = None) -> DataFrame:
    """Tables on top of each other, matched by column name; absent columns are missing.

    Duplicates stay.  ``source_index`` adds the number of the table a row came from (from 1).
    """
    if source_index:
        tables = [t.withColumn(source_index, F.lit(i)) for i, t in enumerate(tables, 1)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def union_distinct(tables: Sequence[DataFrame]) -> DataFrame:
    """Tables on top of each other by position, without repeated rows."""
    return reduce(DataFrame.union, tables).distinct()


def _differs(a: Column, b: Column, tol: float, dtype: str) -> Column:
    if tol > 0 and dtype in ("double", "float"):
        apart = F.coalesce(F.abs(a - b) > tol, F.lit(False))
        return apart | (a.isNull() != b.isNull())
    return ~a.eqNullSafe(b)


def _surplus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows found more often on one side; ``_sf_d`` is the surplus, above zero for ``a``."""
    signed = a.withColumn("_sf_d", F.lit(1)).unionByName(b.withColumn("_sf_d", F.lit(-1)))
    return signed.groupBy(*a.columns).agg(F.sum("_sf_d").alias("_sf_d")).where("_sf_d <> 0")


def _each_row(surplus: DataFrame) -> DataFrame:
    """A row of its own for each unit of surplus, by two short arrays instead of one long one."""
    many = F.abs("_sf_d")
    blocks = surplus.withColumn("_sf_b", F.explode(F.sequence(F.lit(0), F.floor((many - 1) / 1000))))
    inside = F.least(F.lit(1000).cast("bigint"), many - F.col("_sf_b") * 1000)
    return blocks.withColumn("_sf_i", F.explode(F.sequence(F.lit(1).cast("bigint"), inside))).drop("_sf_b", "_sf_i")


def dataset_compare(a: DataFrame, b: DataFrame, keys: Sequence[str] | None = None,
                    tol: float = 0.0, hot_rows: int | None = None) -> DataFrame:
    """Differences between two tables with the same columns.

    With ``keys``: one row per differing cell (side 'changed', column and both values as text)
    and one per row on one side only ('only_a' / 'only_b').  Rows that repeat a key pair by
    position, in the order of their other columns, once equal rows have been taken off both
    sides; a table never differs from itself.  Missing keys match missing keys.  Without keys:
    each distinct row found more often on one side, with the surplus.  Either way equal rows
    cancel in one aggregate over whole rows, so a key with very many rows is spread out, and
    only what differs is stored and paired.  Tables of different columns or types can't be
    compared so, nor does a tolerance without keys mean anything: both raise an error.
    """
    if sorted(a.dtypes) != sorted(b.dtypes):
        raise ValueError(f"columns differ: {sorted(set(a.dtypes) ^ set(b.dtypes))}")
    if tol and not keys:
        raise ValueError("a tolerance needs keys")
    surplus = _surplus(a, b)
    if not keys:
        side = F.when(F.col("_sf_d") > 0, F.lit("only_a")).otherwise(F.lit("only_b"))
        return surplus.select(side.alias("side"), F.abs("_sf_d").cast("bigint").alias("surplus"), *a.columns)
    keys = list(keys)
    rest = [c for c in a.columns if c not in keys]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(True).alias("_sf_none"))
    apart = _sized(_each_row(surplus).select(*keys, (F.col("_sf_d") > 0).alias("_sf_in_a"), row.alias("_sf_row")),
                   "differences")
    numbered = positions(apart, [*keys, "_sf_in_a"], ["_sf_row"], "_sf_rn", hot_rows)
    paired = numbered.groupBy(*keys, "_sf_rn").agg(
        F.first(F.when(F.col("_sf_in_a"), F.col("_sf_row")), ignorenulls=True).alias("_sf_a"),
        F.first(F.when(~F.col("_sf_in_a"), F.col("_sf_row")), ignorenulls=True).alias("_sf_b"))
    types = dict(a.dtypes)

    def cell(side: str, column, va, vb) -> Column:
        return F.struct(F.lit(side).alias("side"), column.cast("string").alias("column_name"),
                        va.cast("string").alias("a_value"), vb.cast("string").alias("b_value"))

    none, va, vb = F.lit(None), F.col("_sf_a"), F.col("_sf_b")
    cells = [F.when(_differs(va[c], vb[c], tol, types[c]), cell("changed", F.lit(c), va[c], vb[c])) for c in rest]
    found = F.when(vb.isNull(), F.array(cell("only_a", none, none, none))) \
        .when(va.isNull(), F.array(cell("only_b", none, none, none))) \
        .otherwise(F.array_compact(F.array(*cells)) if cells else F.array())
    return paired.select(*keys, F.inline(found))


#: Bits of the key's hash that a digest level adds, and unequal buckets above which finer levels are not worth a scan.
DIGEST_BITS, MANY_BUCKETS = (12, 12), 256


def _digests(df: DataFrame, keys: Sequence[str], bits: int) -> DataFrame:
    """Per bucket of the key's hash: rows and two sums of row hashes, which don't depend on the order of rows."""
    # The hash passes over missing values, so where they are goes in as well.
    cells = [x for c in sorted(df.columns) for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    wide = lambda h: F.sum(h.cast("decimal(38,0)"))
    return df.groupBy(_bucket(keys, bits).alias("_sf_bucket")).agg(
        F.count("*").alias("_sf_rows"), wide(F.xxhash64(*cells)).alias("_sf_1"), wide(F.xxhash64(F.lit("2"), *cells)).alias("_sf_2"))


def _bucket(keys: Sequence[str], bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), 64 - bits)


def unequal_parts(a: DataFrame, b: DataFrame, keys: Sequence[str], bits: Sequence[int] = DIGEST_BITS,
                  many: int = MANY_BUCKETS) -> tuple[DataFrame, DataFrame]:
    """The rows of both tables whose keys lie in buckets that are not equal, by a tree of digests.

    Each level splits the buckets that differ into 2 to the power of its bits and compares digests again; only digests are
    shuffled.  At most ``many`` times 2 to that power buckets go to the tasks; where more differ, the level before decides.
    Equal rows in another order, also repeated ones, are equal.
    """
    parts, total, suspects = (a, b), 0, None
    for step in bits:
        total += step
        x, y = (_digests(p, keys, total).alias(n) for p, n in zip(parts, "xy"))
        differ = F.lit(False)
        for c in ("_sf_rows", "_sf_1", "_sf_2"):
            differ = differ | ~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
        joined = x.join(y, F.col("x._sf_bucket") == F.col("y._sf_bucket"), "full")
        found = _sized(joined.where(differ).select(F.coalesce("x._sf_bucket", "y._sf_bucket").alias("_sf_suspect")), "unequal-buckets")
        suspects, used = found, total
        parts = tuple(p.join(F.broadcast(suspects), _bucket(keys, used) == F.col("_sf_suspect"), "left_semi") for p in (a, b))
        if found.limit(many + 1).count() > many:
            break
    return parts


def large_dataset_compare(a: DataFrame, b: DataFrame, keys: Sequence[str], tol: float = 0.0,
                          bits: Sequence[int] = DIGEST_BITS, hot_rows: int | None = None) -> DataFrame:
    """``dataset_compare`` with keys for large tables of which little differs.

    Rows are shuffled only where the digests of both sides differ: two scans of digests in place of a shuffle of all rows.
    The result is the same.
    """
    if sorted(a.dtypes) != sorted(b.dtypes):
        raise ValueError(f"columns differ: {sorted(set(a.dtypes) ^ set(b.dtypes))}")
    part_a, part_b = unequal_parts(a, b, list(keys), bits)
    return dataset_compare(part_a, part_b, keys, tol, hot_rows)


def compare_verdict(a: DataFrame, b: DataFrame, keys: Sequence[str] | None = None,
                    tol: float = 0.0) -> DataFrame:
    """One row: counts of each kind of difference and PASS or FAIL."""
    diff = dataset_compare(a, b, keys, tol)
    weight = F.lit(1) if keys else F.col("surplus")

    def n(side: str) -> Column:
        hits = F.sum(F.when(F.col("side") == side, weight))
        return F.coalesce(hits, F.lit(0)).cast("bigint").alias(f"n_{side}")

    totals = diff.agg(n("only_a"), n("only_b"), n("changed"))
    clean = F.col("n_only_a") + F.col("n_only_b") + F.col("n_changed") == 0
    return totals.withColumn("verdict", F.when(clean, F.lit("PASS")).otherwise(F.lit("FAIL")))
