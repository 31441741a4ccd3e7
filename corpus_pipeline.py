"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, mixing, sharding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame; ``run`` writes it as Parquet in the shared
folder and reads it again as the next stage's ``docs``.  All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepframe.llm.common import n_words
from stepframe.llm.decontaminate import contaminations
from stepframe.llm.dedup import deduplicate
from stepframe.llm.mixing import mix_sources
from stepframe.llm.quality import quality_rules
from stepframe.llm.shards import assign_shards
from stepframe.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SHARDS = 40
MIX_SEED = 11

#: Hashing of words, alignment and BM25 have no short SQL; the stages are tested against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, common lines are taken out of the others.

    A null or empty text has too few words and goes; repeated rows are judged alike; an empty table gives none.
    """
    judged = quality_rules(docs).filter("kept")
    return judged.select("doc_id", F.col("clean_text").alias("text"), "lang", "source",
                         F.when(F.col("removed_words") > 0, F.length("clean_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies stays: the one of least id, also of rows with one id and different texts.

    Rows of a null text all stay; an empty table gives none.
    """
    return deduplicate(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    A row is named by its id and text together, so clean rows stay that have the id of another one or none.  Rows of a
    null or empty text stay; repeated rows go or stay together; an empty table gives none.
    """
    row = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    leaks = contaminations(docs.select(row.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = leaks.select(F.col("doc_id").alias("__llm_row")).distinct()
    return docs.select(*COLUMNS).join(found, row == F.col("__llm_row"), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix_sources(docs.select(*COLUMNS), n_words(F.col("text")), seed=MIX_SEED)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its shard, copies together."""
    return assign_shards(docs.select(*COLUMNS), "doc_id", SHARDS)


STAGES = [("quality rules", quality), ("near-duplicates", near_dedup), ("decontamination", decontaminate),
          ("mixing", mix), ("sharding", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
