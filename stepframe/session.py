"""Session helpers: where intermediate tables go and how lineage is cut.

Operators that must freeze an intermediate result (a row order that has to survive the
loss of an executor, for example) write it as a table below ``spark.checkpoint.dir`` and
read it back.  That folder is shared storage named by the cluster; nothing is kept on the
local disk of one machine.  ``scratch`` releases what is made inside it, the end of the session
releases the rest.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


_made: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session; without one a folder below the warehouse, which is shared too."""
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    return (root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stepframe_scratch").rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that has not been used before; it goes when the session's JVM ends."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    _files(spark, path, lambda fs, p: fs.deleteOnExit(p))
    _made.append(path)
    return path


def _files(spark: SparkSession, path: str, use) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    use(p.getFileSystem(spark._jsc.hadoopConfiguration()), p)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that are made inside are deleted at the end; results must have been written or read by then."""
    before = len(_made)
    try:
        yield
    finally:
        while len(_made) > before:
            _files(spark, _made.pop(), lambda fs, p: fs.delete(p, True))


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs that are run inside leave no shuffle files behind; their results must not need them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back, so later stages see one fixed set of rows."""
    path = scratch_path(df.sparkSession, label)
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """A table that grows by rounds: one folder for each below one folder, read as one table.

    A loop that joins with all its earlier rows plans one scan for them, however many rounds there were.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path, self.schema, self.n = spark, scratch_path(spark, label), None, 0

    def add(self, df: DataFrame) -> DataFrame:
        """Store the rows of a round and give them back."""
        path, self.schema = f"{self.path}/round={self.n}", df.schema
        with freed_shuffles(self.spark):
            df.write.parquet(path)
        self.n += 1
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).drop("round")


def replace_table(df: DataFrame, path: str, **options: str) -> None:
    """Store ``df`` at ``path`` in place of what is there, which stays until all is written.

    A write that fails leaves the old table as it was; ``df`` may read it.
    """
    spark, new, old = df.sparkSession, f"{path.rstrip('/')}-new-{uuid.uuid4().hex}", f"{path.rstrip('/')}-old-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(new)
    at = spark._jvm.org.apache.hadoop.fs.Path

    def swap(fs, p) -> None:
        # A store says by its return value that it did not rename.
        there = fs.exists(p)
        if there and not fs.rename(p, at(old)):
            raise OSError(f"{path} can't be moved away; the new rows are in {new}")
        if not fs.rename(at(new), p):
            back = there and not fs.rename(at(old), p)
            raise OSError(f"{new} can't be moved to {path}" + (f"; the old rows are in {old}" if back else ""))
        if there:
            fs.delete(at(old), True)

    _files(spark, path.rstrip("/"), swap)
    spark.catalog.refreshByPath(path)


def scale_conf(input_bytes: int, partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Session settings for a job over ``input_bytes`` of data.

    Enough shuffle partitions that one fits in memory; AQE merges the ones that turn out small
    and splits the ones that a large key fills.  Apply them with ``builder.config(map=...)``.
    """
    partitions = max(200, -(-input_bytes // partition_bytes))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
    }
