"""Missing-value rules: a missing number is lower than every number, a blank text is missing.

Spark answers NULL to a comparison with NULL; the source language answers true or false.
Each comparison below is an ordinary expression that never returns NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _val(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def missing_lt(a, b) -> Column:
    """``a < b`` with missing below every number (two missings are equal)."""
    a, b = _col(a), _val(b)
    return F.coalesce(a < b, a.isNull() & b.isNotNull())


def missing_le(a, b) -> Column:
    a, b = _col(a), _val(b)
    return F.coalesce(a <= b, a.isNull())


def missing_gt(a, b) -> Column:
    a, b = _col(a), _val(b)
    return F.coalesce(a > b, a.isNotNull() & b.isNull())


def missing_ge(a, b) -> Column:
    a, b = _col(a), _val(b)
    return F.coalesce(a >= b, b.isNull())


def is_missing(c) -> Column:
    """NULL, or a text that is empty or all blanks."""
    return F.coalesce(F.rtrim(_col(c).cast("string")), F.lit("")) == ""


def plain_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with these text columns as keys: without trailing blanks, blank ones NULL."""
    text = [c for c, kind in df.dtypes if c in columns and kind == "string"]
    return df.withColumns({c: F.nullif(F.rtrim(F.col(f"`{c}`")), F.lit("")) for c in text}) if text else df


def is_blank(c) -> Column:
    """Text that is NULL, empty or all blanks."""
    return F.coalesce(F.rtrim(_col(c)), F.lit("")) == ""


def not_blank(c) -> Column:
    return F.coalesce(F.rtrim(_col(c)), F.lit("")) != ""
