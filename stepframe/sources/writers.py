"""Writers and named results."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepframe.functions.scalars import path_segment_after
from stepframe.session import replace_table


def library_write(df: DataFrame, library: str, table: str) -> str:
    """Replace a table of a library and return where it is."""
    if "/" in library:
        path = f"{library.rstrip('/')}/{table}.parquet"
        replace_table(df, path)
        return path
    switch_table(df, f"{library}.{table}")
    return f"{library}.{table}"


def create_table_as(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Store a query result as a catalog table, replacing it, and return the stored table."""
    switch_table(df, name, path)
    return df.sparkSession.table(name)


def switch_table(df: DataFrame, name: str, path: str | None = None) -> str | None:
    """Store ``df`` in a new folder, then point the catalog's table ``name`` to it.

    The folder is ``path``, or one below the warehouse, with a suffix of its own.  Returns the
    folder of the rows before, None if there was no table: it is left, since readers that have begun
    go on reading it, and is deleted by whoever knows that they are done.  With the same columns the
    switch is one change of the table's location, so a reader sees the old or the new rows.  With other
    columns, or where it is partitioned, bucketed or of another format, the old table makes room by a change
    of name and comes back if the new one can't take its place; a folder that the catalog manages goes with it.
    A write or switch that fails leaves the old table.  ``df`` may read the table.
    """
    spark, turn = df.sparkSession, uuid.uuid4().hex
    place = path or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name.replace('.', '/')}"
    folder = f"{place.rstrip('/')}-{turn}"
    df.write.parquet(folder)
    there = spark.catalog.tableExists(name)
    told = _described(spark, name) if there else {}
    # A folder takes another's place where the table says no more of it than its format.
    plain = told.get("Provider") == "parquet" and not told.keys() & {"# Partition Information", "Bucket Columns"}
    at = folder.replace("'", "\\'")
    if plain and _columns(spark.table(name)) == _columns(df):
        _change(spark, f"ALTER TABLE {name} SET LOCATION '{at}'")
    elif not there:
        _change(spark, f"CREATE TABLE {name} USING parquet LOCATION '{at}'")
    else:
        new, old = f"{name}_new_{turn}", f"{name}_old_{turn}"
        _change(spark, f"CREATE TABLE {new} USING parquet LOCATION '{at}'")
        _change(spark, f"ALTER TABLE {name} RENAME TO {old}")
        try:
            _change(spark, f"ALTER TABLE {new} RENAME TO {name}")
        except Exception:
            _change(spark, f"ALTER TABLE {old} RENAME TO {name}")
            _change(spark, f"DROP TABLE {new}")
            raise
        _change(spark, f"DROP TABLE {old}")
    spark.catalog.refreshTable(name)
    return told.get("Location")


def _change(spark: SparkSession, statement: str) -> None:
    spark.sql(statement)


def _columns(df: DataFrame) -> list[tuple]:
    return [(f.name, f.dataType.simpleString(), f.metadata) for f in df.schema.fields]


def _described(spark: SparkSession, name: str) -> dict[str, str]:
    return {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}


def create_view(df: DataFrame, name: str) -> DataFrame:
    """Name a query without running it."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def with_labels(df: DataFrame, labels: dict[str, str],
                lengths: dict[str, int] | None = None) -> DataFrame:
    """Attach labels and text lengths as column metadata; a length cuts the text.

    Lengths count characters, not bytes.
    """
    lengths = lengths or {}
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        meta = dict(f.metadata)
        if f.name in lengths:
            meta["length"] = lengths[f.name]
            if f.dataType.typeName() == "string":
                c = F.left(c, F.lit(lengths[f.name]))
        if f.name in labels:
            meta["label"] = labels[f.name]
        out.append(c.alias(f.name, metadata=meta) if meta else c)
    return df.select(*out)


def labelled_export(df: DataFrame, path: str, drop: Sequence[str] = ()) -> DataFrame:
    """Write CSV with column labels as the header row, replacing what is there.

    Returns the frame as written (columns renamed to labels).  Labels must be different.
    """
    kept = df.drop(*drop)
    named = kept.toDF(*[f.metadata.get("label", f.name) for f in kept.schema.fields])
    named.write.mode("overwrite").option("header", True).csv(path)
    return named


def audit_log_lines(writes: DataFrame, at: str, agent: str, path: str) -> DataFrame:
    """``[time] [agent] Wrote: path`` with the job and step taken from the path.

    Paths without ``jobs/<job>`` and ``tasks/<step>`` belong to no log and are left out.
    """
    stamp = F.date_format(F.col(at), "yyyy-MM-dd HH:mm:ss")
    line = F.format_string("[%s] [%s] Wrote: %s", stamp, F.col(agent), F.col(path))
    rows = writes.select(path_segment_after(path, "jobs").alias("job"),
                         path_segment_after(path, "tasks").alias("step"), line.alias("line"))
    return rows.where((F.col("job") != "") & (F.col("step") != ""))


def audit_log_append(spark: SparkSession, writes: DataFrame, at: str, agent: str, path: str,
                     log_path: str, run: str | None = None, buckets: int = 16) -> DataFrame:
    """Append log lines to a log table split by run, step and bucket of jobs, and return the whole log.

    A run that is named and repeated replaces its own lines, so a retry logs nothing twice; without
    a name each call is a run of its own.  A step's lines are in at most ``buckets`` files per run.
    """
    lines = audit_log_lines(writes, at, agent, path)
    split = lines.withColumn("bucket", F.pmod(F.xxhash64("job"), F.lit(buckets)).cast("int"))
    split = split.repartition("step", "bucket")
    split.write.mode("overwrite").partitionBy("step", "bucket").parquet(f"{log_path}/run={run or uuid.uuid4().hex}")
    # With a schema, a step named like a number stays text.
    stored = spark.read.schema(split.schema.add("run", "string")).parquet(log_path)
    return stored.select(*lines.columns)
