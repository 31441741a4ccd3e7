"""Test data from profiles: baseline rows, edge rows and scaled copies.

Values come from hashes of a row key and a seed, so the same rows appear whatever the number
of partitions and however often a task is repeated.  The hash is MD5, which other engines have
too: they can make the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepframe.session import materialize

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def testdata_baseline(rows: DataFrame, key: str, source: DataFrame, columns: Sequence[str],
                      seed: int = 1, exact: bool = True) -> DataFrame:
    """One synthetic row per key, inside the value range and cardinality of the source columns.

    Numbers, dates and times take one of ``n_distinct`` evenly spaced values from lowest to highest,
    booleans one of both if the source has both; texts are ``<column>_<i>`` with i below ``n_distinct``.  ``exact=False``
    counts distinct values with a sketch.
    """
    fields = {f.name: f.dataType for f in source.schema.fields}
    number = {c: isinstance(fields[c], (T.NumericType, *_TIMES, T.BooleanType)) for c in columns}

    def scale(c: str) -> Column:
        """The column as a number."""
        if isinstance(fields[c], T.DateType):
            return F.unix_date(c)
        return F.unix_micros(F.col(c).cast("timestamp")) if isinstance(fields[c], _TIMES) else F.col(c).cast("int") if isinstance(
            fields[c], T.BooleanType) else F.col(c)

    distinct = F.count_distinct if exact else F.approx_count_distinct
    ranges = [F.struct(distinct(c).alias("n"),
                       (F.min(scale(c)) if number[c] else F.lit(0)).alias("lo"),
                       (F.max(scale(c)) if number[c] else F.lit(0)).alias("hi")).alias(c) for c in columns]
    # One row, stored: the source is read once however many columns ask for it.
    profile = materialize(source.select(F.struct(*ranges).alias("profile")), "profile").scalar()
    out = [F.col(key)]
    for c in columns:
        of = profile[c]
        n = F.greatest(of["n"], F.lit(1))
        digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(c), F.col(key).cast("string")))
        pick = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % n
        if number[c]:
            value = of["lo"] + (of["hi"] - of["lo"]) * pick / F.greatest(n - 1, F.lit(1))
            value = F.floor(value) if isinstance(fields[c], (*_WHOLE, *_TIMES, T.BooleanType)) else value
            if isinstance(fields[c], T.DateType):
                value = F.date_from_unix_date(value.cast("int"))
            elif isinstance(fields[c], _TIMES):
                value = F.timestamp_micros(value.cast("bigint"))
            out.append(value.cast(fields[c]).alias(c))
        else:
            out.append(F.concat(F.lit(f"{c}_"), pick.cast("string")).alias(c))
    return rows.select(*out)


def testdata_edges(profile: DataFrame) -> DataFrame:
    """Boundary cases per profiled column: lowest, highest, missing, blank or zero."""
    numeric = F.col("mean").isNotNull()
    cases = F.array(
        F.struct(F.lit("lowest").alias("edge"), F.col("lowest").alias("value")),
        F.struct(F.lit("highest").alias("edge"), F.col("highest").alias("value")),
        F.struct(F.lit("missing").alias("edge"), F.lit(None).cast("string").alias("value")),
        F.struct(F.when(numeric, F.lit("zero")).otherwise(F.lit("blank")).alias("edge"),
                 F.when(numeric, F.lit("0")).otherwise(F.lit("")).alias("value")))
    return profile.select("column_name", F.inline(cases))


def testdata_stress(df: DataFrame, factor: int, keys: Sequence[str]) -> DataFrame:
    """``factor`` copies of every row with the key columns moved up, copy by copy.

    Distributions stay as they are and keys stay unique: copy i adds i times the keys' whole span.
    """
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    shifted = {k: F.col(k) + F.col("copy") * df.select(F.max(k) - F.min(k) + 1).scalar() for k in keys}
    return copies.withColumns(shifted)
