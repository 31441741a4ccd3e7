"""Partial status updates from a stream of changes.

A batch costs as much as its changes, not as much as the table: its changes are folded to one
row per key and stored as a partition of a changes folder; the table is the base with these rows applied when
it is read.  The base is bucketed by key, so a read shuffles the changes and never the base.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stepframe.operators.load import apply_folded, fold_changes

BUCKETS = 64


def keyed_table(df: DataFrame, name: str, key: str, buckets: int = BUCKETS, path: str | None = None) -> DataFrame:
    """Store ``df`` as a table of the catalog in buckets of ``key`` and read it back; ``path`` is where its files go.

    Rows come to the writer by bucket, so there is one file per bucket.
    """
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def store_changes(folded: DataFrame, path: str, batch_id: int) -> None:
    """Store the folded changes of a batch; a repeated batch takes the place of its first writing."""
    (folded.withColumn("batch", F.lit(batch_id).cast("bigint")).write.partitionBy("batch").mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").parquet(path))


def status_now(base: DataFrame, path: str, key: str, fields: Sequence[str], version: str | None = "version",
               updated: str | None = "updated_at", since: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """The base with all stored batches from ``since`` on; a later batch wins over an earlier one.

    To start from a new base, store this as a ``keyed_table`` and read with ``since`` the next batch; the old base and
    batches serve readers that have begun and can go afterwards.
    """
    spark, types = base.sparkSession, dict(base.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in [key, *fields]), "bumps int",
                        f"changed_at {types[updated] if updated else 'timestamp_ntz'}", "batch bigint"])
    # The filter is on the folder name, so batches inside the base are not read.
    changes = spark.read.schema(schema).parquet(path).where(F.col("batch") >= since)
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("batch"))).alias(f) for f in fields]
    folded = changes.repartition(buckets, key).groupBy(key).agg(
        *last, F.sum("bumps").cast("int").alias("bumps"), F.max("changed_at").alias("changed_at"))
    return apply_folded(base, folded, key, fields, version, updated)


def stream_status_upsert(changes: DataFrame, path: str, key: str, fields: Sequence[str], checkpoint: str,
                         order_by: Sequence[str], blank_ignored: Sequence[str] = (),
                         version_on: str | None = None, at: str | None = None) -> StreamingQuery:
    """Take up the changes that are there now and store them by batch below ``path``.

    Inside a batch the changes of a key are folded in ``order_by`` order.
    """

    def take_up(batch: DataFrame, batch_id: int) -> None:
        store_changes(fold_changes(batch, key, order_by, fields, blank_ignored, version_on, at), path, batch_id)

    return (changes.writeStream.foreachBatch(take_up).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
