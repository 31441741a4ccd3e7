"""Column profiles that are kept per load and merged without reading old data again.

A load's profile is one small row per column: counts, ends, sum, and two sketches of fixed size, one of
the distinct values and one of the distribution.  Merging adds and unites them, so a table that grows by
loads is profiled by a pass over the new load only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepframe.session import materialize

#: Size of the distinct sketch (2**12 registers) and of the quantile sketch.
LG_K, K = 12, 400
#: Stated bounds: distinct counts by three standard errors of the sketch, ranks of quantiles.
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (LG_K / 2), 0.015
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _number(df: DataFrame, f: T.StructField) -> Column | None:
    """The column as a double: dates as days, times as microseconds since 1970; None for others."""
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(f.dataType, _TIMES):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double") if isinstance(f.dataType, (T.NumericType, T.BooleanType)) else None


def load_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column, from one pass: the state that ``merge_profiles`` takes.

    ``low``, ``high``, ``total`` and ``quantiles`` are of numbers, dates (days) and times (microseconds), NaN
    left out; ``low_text`` and ``high_text`` of texts.  An empty table gives zero counts and missing ends.
    """
    none, entries, aggs = F.lit(None), [], [F.count(F.lit(1)).alias("_sf_rows")]
    for i, f in enumerate(f for f in df.schema.fields if columns is None or f.name in columns):
        c, number = F.col(f"`{f.name}`"), _number(df, f)
        finite = F.when(~F.isnan(number), number) if number is not None else none.cast("double")
        text = c if isinstance(f.dataType, T.StringType) else none.cast("string")
        # A hash, since the sketch takes whole numbers and texts only.
        state = {"n_present": F.count(c), "n_numbers": F.count(finite), "distinct": F.hll_sketch_agg(
            F.when(c.isNotNull(), F.xxhash64(c)), LG_K), "low": F.min(finite), "high": F.max(finite),
            "total": F.sum(finite), "low_text": F.min(text), "high_text": F.max(text),
            "quantiles": F.kll_sketch_agg_double(finite, K)}
        aggs += [a.alias(f"_sf_{n}{i}") for n, a in state.items()]
        entries.append(F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type"),
                                F.col("_sf_rows").alias("n_rows"), *[F.col(f"_sf_{n}{i}").alias(n) for n in state]))
    return df.agg(*aggs).select(F.inline(F.array(*entries)))


def store_profile(profile: DataFrame, path: str, load: str) -> None:
    """Keep a load's profile; a load that is repeated replaces its own."""
    profile.write.mode("overwrite").parquet(f"{path}/load={load}")


def stored_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merge_profiles(profiles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The profile of all loads together (or per ``by``); a column has one type in all of them, else one row per type."""
    return profiles.groupBy(*by, "column_name", "type").agg(
        *[F.sum(c).alias(c) for c in ("n_rows", "n_present", "n_numbers")], F.hll_union_agg("distinct").alias("distinct"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"),
        F.min("low_text").alias("low_text"), F.max("high_text").alias("high_text"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"))


def _quantiles(ranks: Sequence[float]) -> Column:
    at = F.array(*[F.lit(float(r)) for r in ranks])
    return F.when(F.col("n_numbers") > 0, F.kll_sketch_get_quantile_double("quantiles", at))


def read_profile(profile: DataFrame, ranks: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """A state as figures: rows, missing, distinct with its error, ends, mean and values at ``ranks``.

    Counts and ends are exact; distinct values are within ``distinct_error`` (a share), the true rank of a
    value in ``at_ranks`` within ``RANK_ERROR`` of the one asked for.
    """
    keep = [c for c in profile.columns if c not in ("n_present", "n_numbers", "distinct", "total", "quantiles")]
    return profile.select(
        *keep, (F.col("n_rows") - F.col("n_present")).alias("n_missing"),
        F.least(F.hll_sketch_estimate("distinct"), "n_present").alias("n_distinct"),
        F.lit(DISTINCT_ERROR).alias("distinct_error"), (F.col("total") / F.nullif("n_numbers", F.lit(0))).alias("mean"),
        _quantiles(ranks).alias("at_ranks"))


def draw_from_profile(rows: DataFrame, key: str, profile: DataFrame, columns: Sequence[str], seed: int = 1,
                      steps: int = 200) -> DataFrame:
    """One synthetic row per key whose numbers, dates and times are spread as the profiled columns are.

    A hash of key, column and seed is a share; the value is the profile's at that rank, between two of
    ``steps`` quantiles in proportion.  As many values are missing as the profile says.  Whole numbers and
    times are rounded down.  A column without numbers is missing throughout.  A stored profile gives the same
    rows each time; quantile sketches of the same load differ within their error, so store it first.
    """
    ranks = [i / steps for i in range(steps + 1)]
    grids = materialize(profile.where(F.col("column_name").isin(*columns)).select(
        "column_name", "type", _quantiles(ranks).alias("grid"), (F.col("n_present") / F.col("n_rows")).alias("given")), "grids")
    # One row per column that is asked for.
    kinds = {r["column_name"]: r["type"] for r in grids.select("column_name", "type").collect()}
    out = [F.col(f"`{key}`")]
    for c in columns:
        of = grids.where(F.col("column_name") == c).select(F.struct("grid", "given")).scalar()

        def share(what: str) -> Column:
            digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(what), F.col(f"`{key}`").cast("string")))
            return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)

        at = share(c) * steps
        low = F.floor(at).cast("int")
        value = F.get(of["grid"], low) + (F.get(of["grid"], low + 1) - F.get(of["grid"], low)) * (at - low)
        value = F.when(share(f"{c}|missing") < of["given"], value)
        kind = kinds[c]
        if kind == "date":
            value = F.date_from_unix_date(F.floor(value).cast("int"))
        elif kind.startswith("timestamp"):
            value = F.timestamp_micros(F.floor(value).cast("bigint")).cast(kind)
        else:
            value = (value if kind in ("double", "float") or kind.startswith("decimal") else F.floor(value)).cast(kind)
        out.append(value.alias(c))
    return rows.select(*out)
