"""Joins: keyed position-by-position merge, presence merges, range lookups, nested children."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepframe.functions.missing import missing_le, plain_text
from stepframe.operators.ordered import _same, _sized, positions, running, split_hot


def _merge_pipeline(frame: DataFrame, by, n, owners, presence, path: str) -> DataFrame:
    sides = range(n)
    order = [f"_sf_ord_{i}" for i in sides]
    if path == "window":
        # One shuffle: numbering, pairing and carrying forward all cluster on the merge keys.
        frame = frame.repartition(*by)
    numbered = positions(frame, [*by, "_sf_side"], order, "_sf_rn", path=path)
    paired = numbered.groupBy(*by, "_sf_rn").agg(
        *[F.first(f"_sf_in_{i}", ignorenulls=True).alias(f"_sf_in_{i}") for i in sides])
    carried: dict[str, Column] = {}
    for g, (owner_sides, columns) in enumerate(owners):
        newest_first = [
            F.when(F.col(f"_sf_in_{i}").isNotNull(),
                   F.struct(*[F.col(f"_sf_in_{i}")[c].alias(c) for c in columns]))
            for i in reversed(owner_sides)]
        carried[f"_sf_g_{g}"] = F.coalesce(*newest_first)
    for i, flag in enumerate(presence or []):
        carried[flag] = F.when(F.col(f"_sf_in_{i}").isNotNull(), F.lit(True))
    if path == "window":
        return running(paired, by, ["_sf_rn"], None, carried, path=path)
    # A table supplies rows at positions 1 to n without a gap, so what is carried past n is its
    # value at n: one row per key, and only large groups come here.
    filled = paired.withColumns(carried)
    ends = filled.groupBy(*by).agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_sf_rn"))).alias(f"{c}_end")
        for c in carried])
    ends = _sized(ends, "ends")
    joined = filled.alias("f").join(ends.alias("e"), _same("f", "e", by))
    return joined.select(
        *[F.col(f"f.`{k}`") for k in by], "_sf_rn",
        *[F.coalesce(F.col(f"f.`{c}`"), F.col(f"e.`{c}_end`")).alias(c) for c in carried])


def _compared(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df`` with its keys as they compare, in columns ``_sf_key_0`` and so on: trailing blanks don't count, a blank text is missing."""
    named = [f"_sf_key_{i}" for i in range(len(by))]
    return plain_text(df.withColumns({n: F.col(f"`{k}`") for n, k in zip(named, by)}), named)


def _same_keys(left: str, right: str, by: Sequence[str]) -> Column:
    return _same(left, right, [f"_sf_key_{i}" for i in range(len(by))])


def match_merge(inputs: Sequence[tuple[DataFrame, Sequence[str]]], by: Sequence[str],
                presence: Sequence[str] | None = None, hot_rows: int | None = None,
                position: str | None = None) -> DataFrame:
    """Merge tables by key, row by row inside each key group (not an SQL join).

    ``inputs`` is a list of (table, order columns); the order columns fix the row order inside
    a key group and must be unique there.  Row i of each table is paired with row i of the
    others; when a table runs out of rows its last values stay.  A column that several tables
    have takes the value of the last listed table that supplied a row at that position.
    Missing keys match missing keys, a blank text is missing, and trailing blanks of a key don't count: keys come out
    without them.  ``presence`` names one flag per table: true when the
    table has any row in the key group.  ``position`` names an output column with the row
    number inside the group.
    """
    by = list(by)
    parts, columns = [], {}
    for i, (table, order_by) in enumerate(inputs):
        # An order column that is a key has one value in a group, and may be spelled in several ways.
        table = plain_text(table, by)
        payload = [c for c in table.columns if c not in by]
        for c in payload:
            columns.setdefault(c, []).append(i)
        fields = [F.col(c) for c in payload] or [F.lit(True).alias("_sf_none")]
        parts.append(table.select(
            *by, F.lit(i).alias("_sf_side"),
            F.struct(*[F.col(c) for c in order_by]).alias(f"_sf_ord_{i}"),
            F.struct(*fields).alias(f"_sf_in_{i}")))
    frame = parts[0]
    for p in parts[1:]:
        frame = frame.unionByName(p, allowMissingColumns=True)
    owners: dict[tuple, list[str]] = {}
    for c, sides in columns.items():
        owners.setdefault(tuple(sides), []).append(c)
    owners = list(owners.items())

    rest, hot = split_hot(frame, by, hot_rows)
    out = _merge_pipeline(rest, by, len(parts), owners, presence, "window")
    if hot is not None:
        large = _merge_pipeline(hot, by, len(parts), owners, presence, "chunked")
        out = out.select(*large.columns).unionByName(large)
    where = {c: f"_sf_g_{g}" for g, (_, cols) in enumerate(owners) for c in cols}
    flags = [F.coalesce(F.col(p), F.lit(False)).alias(p) for p in presence or []]
    number = [F.col("_sf_rn").alias(position)] if position else []
    return out.select(*by, *[F.col(where[c])[c].alias(c) for c in columns], *flags, *number)


def merge_with_presence(target: tuple[DataFrame, Sequence[str]],
                        source: tuple[DataFrame, Sequence[str]], by: Sequence[str],
                        in_target: str = "in_target", keep_all: bool = False,
                        hot_rows: int | None = None) -> DataFrame:
    """Merge source over target; keep rows of keys the source has, flagged by target membership."""
    merged = match_merge([target, source], by, [in_target, "_sf_in_source"], hot_rows)
    if not keep_all:
        merged = merged.where("_sf_in_source")
    return merged.drop("_sf_in_source")


def full_outer_merge(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Merge of two tables with unique keys: one full join, right wins on shared columns.

    Keys compare without trailing blanks, blank ones as missing, and come out as the right table spells them.
    """
    l = _compared(left.withColumn("_sf_l", F.lit(True)), by).alias("l")
    r = _compared(right.withColumn("_sf_r", F.lit(True)), by).alias("r")
    joined = l.join(r, _same_keys("l", "r", by), "full")
    in_right = F.col("r._sf_r").isNotNull()
    out: list[Column] = [
        F.when(in_right, F.col(f"r.`{k}`")).otherwise(F.col(f"l.`{k}`")).alias(k) for k in by]
    for c in dict.fromkeys([*left.columns, *right.columns]):
        if c in by:
            continue
        if c in left.columns and c in right.columns:
            out.append(F.when(in_right, F.col(f"r.`{c}`")).otherwise(F.col(f"l.`{c}`")).alias(c))
        else:
            out.append(F.col(f"l.`{c}`" if c in left.columns else f"r.`{c}`").alias(c))
    return joined.select(*out)


def not_in_target(source: DataFrame, target: DataFrame, by: Sequence[str]) -> DataFrame:
    """Source rows without a counterpart in the target; missing and blank keys match each other, trailing blanks don't count."""
    kept = _compared(source, by).alias("s").join(_compared(target.select(*by), by).alias("t"), _same_keys("s", "t", by), "left_anti")
    return kept.select(*[F.col(f"s.`{c}`") for c in source.columns])


def in_target(source: DataFrame, target: DataFrame, by: Sequence[str],
              fetch: Sequence[str] = ()) -> DataFrame:
    """Source rows that the target already has, with chosen target columns; keys compare as in ``not_in_target``."""
    s, own = _compared(source, by).alias("s"), [F.col(f"s.`{c}`") for c in source.columns]
    t = _compared(target.select(*dict.fromkeys([*by, *fetch])), by).alias("t")
    if not fetch:
        return s.join(t, _same_keys("s", "t", by), "left_semi").select(*own)
    return s.join(t, _same_keys("s", "t", by)).select(*own, *[F.col(f"t.`{c}`") for c in fetch])


def range_join(df: DataFrame, ranges: DataFrame, value: str, low: str, high: str,
               missing_low: bool = True, cells: int = 64) -> DataFrame:
    """Inner join on ``value between low and high`` as an equality join over buckets.

    A narrow range is filed under a power of two above its length, so it touches at most two
    buckets of that width whatever its length; a value looks up one bucket per width in use.
    A range that holds a whole one of ``cells`` cells, cut so that each has about as many values, is filed under
    each cell that it touches, and a value looks up its own: wide and endless ranges don't meet all values in one bucket.
    A value on several cuts, because very many rows have it, is dealt to the cells between them by a hash.
    The work is a hash or sort-merge join that Spark can broadcast by size or split, never a
    comparison of every value with every range.  Both bounds are included.  With ``missing_low`` a missing
    value or bound counts as lower than every number.
    """
    lowest, any_width = F.lit(-sys.float_info.max), F.lit(2000)

    def num(c: str) -> Column:
        number = F.col(c).cast("double")
        return F.coalesce(number, lowest) if missing_low else number

    shares = F.array(*[F.lit(i / cells) for i in range(1, cells)])
    # At most 63 numbers, from one pass over the values when this is called.
    found = df.select(F.percentile_approx(num(value), shares, F.lit(10 * cells))).first()[0] or [0.0] * (cells - 1)
    cuts = F.array(*[F.lit(x) for x in found])

    def counted(before, first: int = 0, last: int = cells - 1) -> Column:
        """How many cuts come before, by halves: as many comparisons as the number of cells has bits."""
        if first == last:
            return F.lit(first)
        mid = (first + last) // 2
        return F.when(before(F.get("_sf_cuts", F.lit(mid))), counted(before, mid + 1, last)).otherwise(counted(before, first, mid))

    below = lambda c: counted(lambda x: x < F.col(c))
    upto = lambda c: counted(lambda x: x <= F.col(c))
    filed = ranges.withColumns({"_sf_lo": num(low), "_sf_hi": num(high), "_sf_cuts": cuts})
    filed = filed.where("_sf_lo <= _sf_hi").withColumns({"_sf_first": below("_sf_lo"), "_sf_last": upto("_sf_hi")})
    span = F.greatest(F.col("_sf_hi") - F.col("_sf_lo"), F.lit(2.0 ** -32))
    wide = (F.col("_sf_lo") == lowest) | (span > 1e300) | (F.col("_sf_last") - F.col("_sf_first") > 1)
    level = F.when(wide, any_width).otherwise((F.floor(F.log2(span)) + 2).cast("int"))
    filed = filed.withColumn("_sf_level", level)
    # The widths in use: at most one per power of two, however many ranges there are.
    levels = filed.select(F.collect_set("_sf_level")).scalar()
    width = F.pow(F.lit(2.0), F.col("_sf_level"))

    def bucket(c: str) -> Column:
        # Adding zero turns -0.0 into 0.0; as two entries they would match the same rows twice.
        return F.rint(F.col(c) / width) + F.lit(0.0)

    touched = F.transform(F.sequence("_sf_first", "_sf_last"), lambda s: s.cast("double"))
    ends = F.when(F.col("_sf_level") == any_width, touched).otherwise(
        F.array_distinct(F.array(bucket("_sf_lo"), bucket("_sf_hi"))))
    filed = filed.withColumn("_sf_bucket", F.explode(ends)).drop("_sf_lo", "_sf_hi", "_sf_cuts", "_sf_first", "_sf_last")
    probe = df.withColumns({"_sf_v": num(value), "_sf_levels": levels, "_sf_cuts": cuts}).where("_sf_v is not null")
    # A hash and no random number: a task that is run again files its rows alike.
    turn = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    probe = probe.withColumns({"_sf_first": below("_sf_v"), "_sf_last": upto("_sf_v")})
    own = (F.col("_sf_first") + F.pmod(turn, F.col("_sf_last") - F.col("_sf_first") + 1)).cast("double")
    probe = probe.withColumn("_sf_cell", own).drop("_sf_cuts", "_sf_first", "_sf_last").withColumn("_sf_level", F.explode("_sf_levels"))
    probe = probe.withColumn("_sf_bucket", F.when(F.col("_sf_level") == any_width, F.col("_sf_cell")).otherwise(bucket("_sf_v")))
    v, a, b = F.col(value), F.col(low), F.col(high)
    inside = (missing_le(a, v) & missing_le(v, b)) if missing_low else v.between(a, b)
    joined = probe.drop("_sf_v", "_sf_levels", "_sf_cell").join(filed, ["_sf_level", "_sf_bucket"])
    return joined.where(inside).drop("_sf_level", "_sf_bucket")


def owner_scoped_join(children: DataFrame, parents: DataFrame, on: Column | Sequence[str],
                      owner: str) -> DataFrame:
    """Children with the owner of their parent, for all owners at once (filter for one)."""
    return children.join(parents, on, "inner").where(F.col(owner).isNotNull())


def enrich_by_key(rows: DataFrame, parents: DataFrame, on: Sequence[str],
                  columns: Sequence[str]) -> DataFrame:
    """Parent attributes on each row in one join; rows without a parent are dropped."""
    return rows.join(parents.select(*on, *columns), list(on), "inner")


def nest_children(parents: DataFrame, children: DataFrame, key: str,
                  order_by: Sequence[str], columns: Sequence[str], out: str = "children",
                  page_size: int = 1000, hot_rows: int | None = None) -> DataFrame:
    """Parents with their children as ordered arrays of structs, in pages.

    A parent with no children gets one page with an empty array.  Page ``n`` holds children
    ``n*page_size+1 …``: no array grows with the data, and no child is left out.
    """
    numbered = positions(children.select(*dict.fromkeys([key, *order_by, *columns])),
                         [key], order_by, "_sf_rn", hot_rows)
    page = F.expr(f"(_sf_rn - 1) div {page_size}")
    item = F.struct("_sf_rn", *columns)
    pages = numbered.withColumn("page", page).groupBy(key, "page").agg(
        F.transform(F.array_sort(F.collect_list(item)),
                    lambda x: F.struct(*[x[c].alias(c) for c in columns])).alias(out))
    none = F.array().cast(pages.schema[out].dataType)
    return parents.join(pages, key, "left").withColumns({
        "page": F.coalesce("page", F.lit(0).cast("bigint")), out: F.coalesce(out, none)})
