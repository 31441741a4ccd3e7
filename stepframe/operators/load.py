"""Table loads: replace, append with a fixed schema, delete, insert, update, upsert.

Each operator turns a current table and a change into the new table.  Storing it is a separate
write to a new place, so a failed job leaves the current table whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepframe.operators.ordered import _same
from stepframe.session import replace_table


def align_to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema``: extra ones go, absent ones are missing.

    Values are cast (unreadable ones become missing) and texts cut to the declared length.
    """
    out = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in df.columns \
            else F.lit(None).cast(f.dataType)
        if "length" in f.metadata and isinstance(f.dataType, T.StringType):
            c = F.left(c, F.lit(f.metadata["length"]))
        out.append(c.alias(f.name, metadata=f.metadata))
    return df.select(*out)


def append_force(base: DataFrame, data: DataFrame) -> DataFrame:
    """Append rows to a table whose columns, types and text lengths win."""
    return base.unionByName(align_to_schema(data, base.schema))


def table_load_replace(df: DataFrame, schema: T.StructType, path: str) -> DataFrame:
    """Store ``df`` as a new table of the declared schema at ``path`` and read it back.

    The old table is there until the new one is complete.
    """
    replace_table(align_to_schema(df, schema), path)
    return df.sparkSession.read.schema(schema).parquet(path)


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that do not meet the condition; a condition that is NULL keeps the row."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def literal_rows(df: DataFrame, rows: Sequence[dict]) -> DataFrame:
    """A few literal rows with the columns of ``df``; columns not given are missing."""
    unknown = {k for r in rows for k in r} - set(df.columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    schema = T.StructType([T.StructField(f.name, f.dataType, True, f.metadata)
                           for f in df.schema.fields])
    data = [tuple(r.get(c) for c in df.columns) for r in rows]
    return df.sparkSession.createDataFrame(data, schema)


def insert_values(df: DataFrame, rows: Sequence[dict]) -> DataFrame:
    return df.unionByName(literal_rows(df, rows))


def update_set(df: DataFrame, changes: dict[str, Column], condition: Column | None = None
               ) -> DataFrame:
    """New values for columns, for all rows or for those that meet the condition."""
    if condition is None:
        return df.withColumns(changes)
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in changes.items()})


def sentinel_members(df: DataFrame, key: str, rows: Sequence[dict]) -> DataFrame:
    """Special members of a dimension: remove rows with their keys, then add them.

    Running it again gives the same table.
    """
    keys = [r[key] for r in rows]
    return insert_values(delete_where(df, F.col(key).isin(keys)), rows)


def fold_changes(changes: DataFrame, key: str, order_by: Sequence[str],
                 fields: Sequence[str], blank_ignored: Sequence[str] = (),
                 version_on: str | None = None, at: str | None = None) -> DataFrame:
    """All changes of a key folded into one row: the last given value of each field.

    A missing value means "not given"; for ``blank_ignored`` fields an empty text does too.
    ``bumps`` counts the changes that give ``version_on``, ``changed_at`` is the newest time.
    It is one aggregate that combines before the shuffle, so a key with very many changes
    costs no more than others.
    """
    order = F.struct(*[F.col(c) for c in order_by])
    aggs = []
    for f in fields:
        given = F.col(f).isNotNull()
        if f in blank_ignored:
            given = given & (F.col(f) != "")
        aggs.append(F.max_by(F.col(f), F.when(given, order)).alias(f))
    bumps = F.count(version_on) if version_on else F.lit(0)
    newest = F.max(at) if at else F.lit(None).cast("timestamp_ntz")
    return changes.groupBy(key).agg(*aggs, bumps.cast("int").alias("bumps"),
                                    newest.alias("changed_at"))


def apply_folded(current: DataFrame, folded: DataFrame, key: str, fields: Sequence[str],
                 version: str | None = "version", updated: str | None = "updated_at",
                 insert_new: bool = False) -> DataFrame:
    """The table after folded changes; changes for keys that it lacks are left out, or added
    with ``insert_new``."""
    # Plain equality keeps the folded rows where their aggregate put them.
    joined = current.alias("c").join(folded.alias("n"), F.col(f"c.`{key}`") == F.col(f"n.`{key}`"),
                                     "full" if insert_new else "left")
    new = {key: F.coalesce(F.col(f"c.`{key}`"), F.col(f"n.`{key}`"))}
    for f in fields:
        new[f] = F.coalesce(F.col(f"n.`{f}`"), F.col(f"c.`{f}`"))
    if version:
        old = F.coalesce(F.col(f"c.`{version}`"), F.lit(1))
        new[version] = old + F.coalesce(F.col("n.bumps"), F.lit(0))
    if updated:
        new[updated] = F.coalesce(F.col("n.changed_at"), F.col(f"c.`{updated}`"))
    return joined.select(*[new.get(c, F.col(f"c.`{c}`")).alias(c) for c in current.columns])


def upsert_status(current: DataFrame, changes: DataFrame, key: str, order_by: Sequence[str],
                  fields: Sequence[str], blank_ignored: Sequence[str] = (),
                  version_on: str | None = None, version: str = "version",
                  at: str | None = None, updated: str = "updated_at",
                  insert_new: bool = False) -> DataFrame:
    """Partial updates: only given fields change, code changes raise the version."""
    folded = fold_changes(changes, key, order_by, fields, blank_ignored, version_on, at)
    return apply_folded(current, folded, key, fields, version if version_on else None,
                        updated if at else None, insert_new)


def cascade_delete(parent: DataFrame, doomed: DataFrame, key: str,
                   levels: Sequence[tuple[str, DataFrame, str, str]]) -> dict[str, DataFrame]:
    """Delete parents and everything below them.

    ``levels`` lists (name, table, its own key, its parent key), each below the one before or,
    with a parent key named like an earlier level's key, below that one.  Returns the tables
    that remain, 'parent' first.
    """
    left = {"parent": parent.join(doomed.select(key).distinct(), key, "left_anti")}
    gone = {key: doomed.select(key).distinct()}
    for name, table, own, up in levels:
        if up not in gone:
            raise ValueError(f"{name}: no level above has the key {up}")
        left[name] = table.join(gone[up], up, "left_anti")
        gone[own] = table.join(gone[up], up, "left_semi").select(own).distinct()
    return left


def counter_upsert(counters: DataFrame, events: DataFrame, by: Sequence[str],
                   count: str = "request_count", limit: Column | int | None = None) -> DataFrame:
    """Add the events to their counters; a counter that is not there starts at 0.

    With a limit, events beyond it are refused and do not count; a limit column is one of the
    keys'.  Counters and events are one table with one shuffle, and both combine before it.  Other columns of
    a counter stay and are missing for a new one.
    """
    keys = [F.col(f"`{k}`") for k in by]
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    held = F.coalesce(F.col(f"`{count}`").cast("bigint"), none)
    other = [c for c in counters.columns if c not in by and c != count]
    kept = [F.struct(*[F.col(f"`{c}`") for c in other]).alias("_sf_other")] if other else []
    stacked = counters.select(*keys, held.alias("_sf_old"), none.alias("_sf_n"), *kept).unionByName(
        events.select(*keys, none.alias("_sf_old"), one.alias("_sf_n")), allowMissingColumns=True)
    summed = stacked.groupBy(*by).agg(F.sum("_sf_old").alias("_sf_old"), F.sum("_sf_n").alias("_sf_n"),
                                      *[F.first(c, ignorenulls=True).alias("_sf_other") for c in ["_sf_other"] if other])
    old, total = F.col("_sf_old"), F.col("_sf_old") + F.col("_sf_n")
    if limit is not None:
        total = F.greatest(old, F.least(limit if isinstance(limit, Column) else F.lit(limit), total))
    new = {count: total.cast("bigint"), **{c: F.col("_sf_other")[c] for c in other}, **{k: F.col(f"`{k}`") for k in by}}
    return summed.select(*[new[c].alias(c) for c in ([*by, count] if not other else counters.columns)])
