"""Order-dependent row logic: running values, numbering, surrogate keys, first and last rows.

A window puts a whole group into one task.  That is the cheapest plan while groups are small,
and the wrong one when a single group holds a large part of the table.  ``running`` therefore
counts rows per group first (a partial aggregate, only key columns are read).  Groups above
``hot_rows`` are laid out by range over (group, order), so one group spans many tasks; each
task scans its own stretch, and the stretches are joined up by a small table with one row per
(stretch, group).  Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepframe.operators.ranges import ROWS_PER_RANGE, numbered_by_ranges
from stepframe.session import materialize

HOT_ROWS = 2_000_000
_CHUNK, _POS = "_sf_chunk", "_sf_pos"


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    """Null-safe equality of key columns between two aliased frames."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`"))
    return cond


def split_hot(df: DataFrame, by: Sequence[str], hot_rows: int | None = None):
    """``(rest, hot)``: rows of groups above ``hot_rows`` apart; ``hot`` is None if there are none.

    The table of hot keys has at most ``rows / hot_rows`` rows; it is frozen so that both
    parts always agree on it.
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    keys = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_sf_n"))
    keys = materialize(keys.where(F.col("_sf_n") > hot_rows).select(*by), "hot-keys")
    if keys.isEmpty():
        return df, None
    rows, k = df.alias("rows"), keys.alias("k")
    match = _same("rows", "k", by)
    return rows.join(k, match, "left_anti"), rows.join(k, match, "left_semi")


def _lay_out(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """Rows sorted by ``keys`` over all tasks, frozen, with chunk number and position."""
    pos = F.monotonically_increasing_id()
    laid = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(_POS, pos)
    return materialize(laid, "ordered").withColumn(_CHUNK, F.shiftright(F.col(_POS), 33))


def _sized(df: DataFrame, label: str) -> DataFrame:
    """A small side of a join, stored, so that Spark plans with its real size.

    Below the broadcast limit the large side is then not shuffled at all; above it Spark sorts
    and AQE splits large groups.  Without this, the size of an aggregate is only known after
    the large side has been shuffled for nothing.
    """
    return materialize(df, label)


def _running_window(df, by, order_by, sums, lasts) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    new = {o: F.coalesce(F.sum(e).over(w), F.lit(0)) for o, e in sums.items()}
    new |= {o: F.last(e, ignorenulls=True).over(w) for o, e in lasts.items()}
    return df.withColumns(new)


def _running_chunked(df, by, order_by, sums, lasts) -> DataFrame:
    # Sums of sums are wider, stored structs may hold nulls: both ways give the window's types.
    types = {f.name: f.dataType.simpleString() for f in _running_window(df, by, order_by, sums, lasts).schema.fields}
    laid = _lay_out(df, [*by, *order_by])
    laid = laid.withColumns({f"_sf_v_{o}": e for o, e in {**sums, **lasts}.items()})
    group = [_CHUNK, *by]
    w = Window.partitionBy(*group).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
    totals, before, new = [], [], {}
    earlier = Window.partitionBy(*by).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    for o in sums:
        totals.append(F.sum(f"_sf_v_{o}").alias(f"_sf_t_{o}"))
        before.append(F.sum(f"_sf_t_{o}").over(earlier).alias(f"_sf_b_{o}"))
        new[o] = (F.coalesce(F.sum(f"_sf_v_{o}").over(w), F.lit(0))
                  + F.coalesce(F.col(f"_sf_b_{o}"), F.lit(0)))
    for o in lasts:
        at = F.when(F.col(f"_sf_v_{o}").isNotNull(), F.col(_POS))
        totals.append(F.max_by(F.col(f"_sf_v_{o}"), at).alias(f"_sf_t_{o}"))
        before.append(F.last(f"_sf_t_{o}", ignorenulls=True).over(earlier).alias(f"_sf_b_{o}"))
        here = F.last(f"_sf_v_{o}", ignorenulls=True).over(w)
        new[o] = F.coalesce(here.cast(types[o]), F.col(f"_sf_b_{o}").cast(types[o]))
    starts = _sized(laid.groupBy(*group).agg(*totals).select(*group, *before), "starts")
    joined = laid.alias("l").join(starts.alias("s"), _same("l", "s", group), "left")
    joined = joined.select("l.*", *[f"s.`_sf_b_{o}`" for o in {**sums, **lasts}])
    kept = [c for c in df.columns if c not in new]
    return joined.withColumns({o: c.cast(types[o]) for o, c in new.items()}).select(*kept, *new)


def running(df: DataFrame, by: Sequence[str], order_by: Sequence[str | Column],
            sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None,
            hot_rows: int | None = None, path: str = "auto") -> DataFrame:
    """Running sums and carried-forward last values per group, in a stated order.

    ``path`` is "auto", "window" (one task per group) or "chunked" (groups span tasks).
    With no ``by`` columns the whole table is one group and "auto" means "chunked".
    """
    sums, lasts = sums or {}, lasts or {}
    if path == "window":
        return _running_window(df, by, order_by, sums, lasts)
    if path == "chunked" or not by:
        return _running_chunked(df, by, order_by, sums, lasts)
    rest, hot = split_hot(df, by, hot_rows)
    out = _running_window(rest, by, order_by, sums, lasts)
    if hot is not None:
        out = out.unionByName(_running_chunked(hot, by, order_by, sums, lasts))
    return out


def _positions_chunked(df, by, order_by, out: str) -> DataFrame:
    """Row numbers from the position in the layout: after it nothing is shuffled but counts."""
    laid = _lay_out(df, [*by, *order_by])
    group = [_CHUNK, *by]
    runs = laid.groupBy(*group).agg(F.min(_POS).alias("_sf_first"), F.count(F.lit(1)).alias("_sf_n"))
    earlier = Window.partitionBy(*by).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_sf_n").over(earlier), F.lit(0))
    starts = runs.select(*group, (before - F.col("_sf_first") + 1).alias("_sf_shift"))
    starts = _sized(starts, "starts")
    joined = laid.alias("l").join(starts.alias("s"), _same("l", "s", group))
    number = (F.col(_POS) + F.col("_sf_shift")).cast("bigint").alias(out)
    return joined.select(*[F.col(f"l.`{c}`") for c in df.columns if c != out], number)


def positions(df: DataFrame, by: Sequence[str], order_by: Sequence[str | Column],
              out: str = "rn", hot_rows: int | None = None, path: str = "auto") -> DataFrame:
    """Row number (from 1) inside each group; ``path`` as in ``running``."""
    one = {out: F.lit(1).cast("bigint")}
    if path == "window":
        return _running_window(df, by, order_by, one, {})
    if path == "chunked" or not by:
        return _positions_chunked(df, by, order_by, out)
    rest, hot = split_hot(df, by, hot_rows)
    numbered = _running_window(rest, by, order_by, one, {})
    if hot is not None:
        numbered = numbered.unionByName(_positions_chunked(hot, by, order_by, out))
    return numbered


def retain_counter(df: DataFrame, by: Sequence[str], order_by: Sequence[str | Column],
                   condition: Column, start: int = 0, out: str = "counter",
                   hot_rows: int | None = None) -> DataFrame:
    """Counter that starts at ``start`` and grows by one at each row that meets the condition."""
    step = F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    counted = running(df, by, order_by, {out: step}, None, hot_rows)
    return counted.withColumn(out, F.col(out) + F.lit(start))


def dense_row_id(df: DataFrame, order_by: Sequence[str | Column], start=1,
                 out: str = "id", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Gap-free global numbering in a stated order, without passing all rows through one task.

    Named columns (ascending, missing first): by ranges between stored cut points, the table is not
    copied.  Other orders: the sorted rows are stored once and only counts per chunk are summed up.
    ``start`` is a number or a Column (for example a scalar subquery).
    """
    first = start if isinstance(start, Column) else F.lit(start)
    if order_by and all(isinstance(c, str) and c in df.columns and c != out for c in order_by):
        numbered = numbered_by_ranges(df, list(order_by), out, _positions_chunked, rows_per_range)
    else:
        numbered = _positions_chunked(df, [], order_by, out)
    return numbered.withColumn(out, (F.col(out) - 1 + first).cast("bigint"))


def first_last_flags(df: DataFrame, order_key: str, by: Sequence[str] = ()) -> DataFrame:
    """``is_first`` / ``is_last`` per group (or whole table) by a unique order column.

    Uses min and max (partial aggregates) instead of sorting a group in one task.
    """
    ends = [F.min(order_key).alias("_sf_lo"), F.max(order_key).alias("_sf_hi")]
    if by:
        edges = _sized(df.groupBy(*by).agg(*ends), "edges")
        out = df.alias("d").join(edges.alias("e"), _same("d", "e", by))
        out = out.select("d.*", "_sf_lo", "_sf_hi")
    else:
        edges = df.select(F.struct(*ends)).scalar()
        out = df.withColumns({"_sf_lo": edges["_sf_lo"], "_sf_hi": edges["_sf_hi"]})
    return out.withColumns({"is_first": F.col(order_key) == F.col("_sf_lo"),
                            "is_last": F.col(order_key) == F.col("_sf_hi")}
                           ).drop("_sf_lo", "_sf_hi")


def having_remerge(df: DataFrame, value: str, agg=F.max, by: Sequence[str] = ()) -> DataFrame:
    """Rows whose value equals the aggregate of all rows (or of their group); ties are kept."""
    if not by:
        target = df.select(agg(value)).scalar()
        return df.where(F.col(value) == target)
    return group_remerge(df, by, {"_sf_target": agg(value)}).where(
        F.col(value) == F.col("_sf_target")).drop("_sf_target")


def group_remerge(df: DataFrame, by: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    """Group aggregates put back on every row.

    Aggregate, then join: the aggregate combines before the shuffle, and the join can be
    broadcast or split by AQE when one group is large, which a window cannot.
    """
    grouped = _sized(df.groupBy(*by).agg(*[a.alias(o) for o, a in aggs.items()]), "groups")
    joined = df.alias("d").join(grouped.alias("g"), _same("d", "g", by))
    return joined.select("d.*", *[f"g.`{o}`" for o in aggs])


def top_n_per_group(df: DataFrame, by: Sequence[str], order_by: Sequence[Column],
                    n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows per group; Spark cuts each map task to ``n`` per group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order_by)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)


def usage_limit_flag(requests: DataFrame, by: Sequence[str], order_by: Sequence[str],
                     limit: int, request_key: str) -> DataFrame:
    """Accept the first ``limit`` requests per group; later ones are rejected and not counted.

    Every row is a request, also where ``request_key`` repeats; the key only breaks ties of the order.
    """
    order = list(dict.fromkeys([*order_by, request_key]))
    numbered = positions(requests, by, order, out="used_after")
    return numbered.withColumns({
        "accepted": F.col("used_after") <= limit,
        "used_after": F.least(F.col("used_after"), F.lit(limit)).cast("int")})


def versions(changes: DataFrame, key: Sequence[str], order_by: Sequence[str | Column],
             base: int = 1, hot_rows: int | None = None) -> DataFrame:
    """Version after each change: ``base`` plus the number of changes so far."""
    numbered = positions(changes, key, order_by, "version", hot_rows)
    return numbered.withColumn("version", F.col("version") + F.lit(base))


def latest_version(changes: DataFrame, key: Sequence[str], order_by: Sequence[str],
                   keep: Sequence[str], base: int = 1) -> DataFrame:
    """Final version per key with the columns of its last change, by one partial aggregate."""
    order = F.struct(*[F.col(c) for c in order_by])
    last = F.max_by(F.struct(*[F.col(c) for c in keep]), order).alias("_sf_last")
    version = (F.count(F.lit(1)) + F.lit(base)).alias("version")
    return changes.groupBy(*key).agg(version, last).select(*key, "version", "_sf_last.*")


def first_match(df: DataFrame, by: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key: the first in a stated order."""
    rest = [c for c in df.columns if c not in by]
    order = F.struct(*[F.col(c) for c in order_by])
    one = F.min_by(F.struct(*[F.col(c) for c in rest]), order).alias("_sf_row")
    return df.groupBy(*by).agg(one).select(*by, "_sf_row.*").select(*df.columns)


def max_key(df: DataFrame, key: str, default: int = 0) -> Column:
    """Highest key as a scalar; an empty or all-missing table gives the default."""
    return df.select(F.coalesce(F.max(key), F.lit(default)).cast("bigint")).scalar()


def start_value(start_from, target: DataFrame | None = None, key: str | None = None) -> Column:
    """Last used key: a fixed first value, a one-row lookup table, or the target's maximum."""
    if isinstance(start_from, int):
        return F.lit(start_from - 1).cast("bigint")
    if isinstance(start_from, DataFrame):
        column = start_from.columns[0]
        return max_key(start_from, column)
    if start_from == "target":
        return max_key(target, key) if target is not None else F.lit(0).cast("bigint")
    raise ValueError("start_from is a number, a one-row DataFrame or 'target'")


def surrogate_keys(source: DataFrame, target: DataFrame | None, business_key: Sequence[str],
                   key: str, order_by: Sequence[str], mode: str = "new", keep: str = "input",
                   start_from="target") -> DataFrame:
    """Give a surrogate key to source rows.

    mode="all": every source row gets a new number after the start value, in ``order_by``.
    mode="new": rows whose business key is in the target keep the target's key and its other
    columns where the source has none; only the others are numbered, in business-key order
    with ``order_by`` as tie-break.  keep="all" also returns target rows absent from the source.
    The target has one row per business key.
    """
    source = source.drop(key)
    last = start_value(start_from, target, key)
    if mode == "all" or target is None:
        order = list(dict.fromkeys(order_by if mode == "all" else [*business_key, *order_by]))
        return dense_row_id(source, order, last + F.lit(1), key)
    extra = [c for c in target.columns if c not in source.columns and c != key]
    new = source.alias("s").join(
        target.select(*business_key).alias("t"), _same("s", "t", business_key), "left_anti")
    order = list(dict.fromkeys([*business_key, *order_by]))
    numbered = dense_row_id(new, order, last + F.lit(1), key)
    known = source.alias("s").join(target.alias("t"), _same("s", "t", business_key))
    known = known.select("s.*", *[f"t.`{c}`" for c in extra], F.col(f"t.`{key}`").cast("bigint"))
    out = known.unionByName(numbered, allowMissingColumns=True)
    if keep == "all":
        absent = target.alias("t").join(
            source.select(*business_key).alias("s"), _same("t", "s", business_key), "left_anti")
        out = out.unionByName(absent, allowMissingColumns=True)
    return out


def advance_lookup(lookup: DataFrame, source: DataFrame, target: DataFrame | None = None,
                   business_key: Sequence[str] = ()) -> DataFrame:
    """The one-row table of the last used key after ``surrogate_keys`` has used it.

    It moves up by the number of rows that got a new key: all of the source, or with a target
    those whose business key the target lacks.
    """
    if target is not None:
        source = source.alias("s").join(
            target.select(*business_key).alias("t"), _same("s", "t", business_key), "left_anti")
    column = lookup.columns[0]
    used = source.select(F.count(F.lit(1))).scalar()
    return lookup.withColumn(column, F.coalesce(F.col(column), F.lit(0)) + used)
