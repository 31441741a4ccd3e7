"""Sharding by jump consistent hashing.

A key goes through a row of pseudo-random jumps; its shard is the last jump below the number of
shards.  No table of shards is kept, and when a shard is appended a key stays or goes to the new one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stepframe.llm.common import OWN, with_new

# Fixed values of the published method: a 64-bit multiplier with increment 1, and 2^31.
MULTIPLIER = 2862933555777941757
JUMP = 2147483648.0

_LOW = 0xFFFFFFFF
_M_HIGH, _M_LOW = MULTIPLIER >> 32, MULTIPLIER & _LOW


def _next_low(low: Column) -> tuple[Column, Column]:
    """Low half of ``key * MULTIPLIER + 1`` and what it carries over, in steps that stay below 2^63."""
    upper = F.shiftright(low, 16) * F.lit(_M_LOW)
    total = low.bitwiseAND(F.lit(0xFFFF)) * F.lit(_M_LOW) + F.lit(1) + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16)
    return total.bitwiseAND(F.lit(_LOW)), F.shiftright(total, 32) + F.shiftright(upper, 16)


def _next_high(high: Column, low: Column, carry: Column) -> Column:
    upper = (F.shiftright(high, 16) * F.lit(_M_LOW)).bitwiseAND(F.lit(0xFFFF))
    return (low * F.lit(_M_HIGH) + high.bitwiseAND(F.lit(0xFFFF)) * F.lit(_M_LOW) + F.shiftleft(upper, 16)
            + carry).bitwiseAND(F.lit(_LOW))


def jump_path(key: Column, most: int) -> Column:
    """The jumps of a long key below ``most``, ascending, the first one 0."""
    state = F.struct(F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(F.lit(_LOW)).alias("low"),
                     F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("path"))

    def step(s: Column, _: Column) -> Column:
        low, carry = _next_low(s["low"])
        high = _next_high(s["high"], s["low"], carry)
        far = F.floor((s["at"] + 1).cast("double") * (F.lit(JUMP) / (F.shiftright(high, 1) + 1).cast("double")))
        return F.when(s["at"] >= most, s).otherwise(F.struct(
            high.alias("high"), low.alias("low"), far.cast("long").alias("at"),
            F.concat(s["path"], F.array(s["at"])).alias("path")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), state, step, lambda s: s["path"])


def shard_of(path: Column, shards: int) -> Column:
    return F.array_max(F.filter(path, lambda x: x < shards)).cast("int")


def shard_key(df: DataFrame, column: str) -> Column:
    """A whole number is its own key; any other type is hashed.  A missing key counts as 0."""
    whole = isinstance(df.schema[column].dataType, T.IntegralType)
    key = F.col(f"`{column}`") if whole else F.when(F.col(f"`{column}`").isNotNull(), F.xxhash64(f"`{column}`"))
    return F.coalesce(key.cast("long"), F.lit(0).cast("long"))


def assign_shards(df: DataFrame, key: str, shards: int, name: str = "shard", grown: str | None = None) -> DataFrame:
    """``df`` with the shard of each row, 0 to ``shards - 1``; ``grown`` names a column for one shard more.

    Nothing is shuffled.  Rows with equal keys share a shard, rows without a key go to the shard of
    key 0, an empty table stays empty; an input column of the new name is replaced, others stay.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    at = F.col(OWN + "path")
    new = {name: shard_of(at, shards)} | ({grown: shard_of(at, shards + 1)} if grown else {})
    return with_new(df.withColumn(OWN + "path", jump_path(shard_key(df, key), shards + 1)), **new)


def shard_slots(rows: DataFrame, shard: str, order: list[str], block_rows: int = 20_000) -> DataFrame:
    """Number the rows of each shard from 0 without a gap, in blocks; adds ``slot``.

    ``rows`` is one row per document, of small columns.  Equal rows are counted before the shuffle and
    handed out again at the end, so no repeated row makes a large group.  A block is a hash of the
    row; it is numbered by itself and begins where the blocks before it end.
    """
    columns = rows.columns
    blocks = max(1, math.ceil(rows.count() / block_rows))
    counted = rows.groupBy(*columns).agg(F.count("*").alias(OWN + "n")).withColumn(
        OWN + "block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    inside = Window.partitionBy(shard, OWN + "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(shard).orderBy(OWN + "block").rowsBetween(Window.unboundedPreceding, -1)
    begins = counted.groupBy(shard, OWN + "block").agg(F.sum(OWN + "n").alias(OWN + "all")).select(
        shard, OWN + "block", F.coalesce(F.sum(OWN + "all").over(before), F.lit(0)).alias(OWN + "begin"))
    at = F.col(OWN + "begin") + F.coalesce(F.sum(OWN + "n").over(inside), F.lit(0))
    return (counted.join(begins, [shard, OWN + "block"])
            .select(*columns, at.alias(OWN + "at"), OWN + "n")
            .select(*columns, F.explode(F.sequence(F.col(OWN + "at"), F.col(OWN + "at") + F.col(OWN + "n") - 1))
                    .alias("slot")))
