"""What several operators share: word patterns, bound values, internal and new columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Internal columns begin with this, so that no other name of an input clashes with them.
OWN = "__llm_"


def words(text: Column) -> Column:
    """The words of a text in order; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def lower_words(text: str) -> list[bytes]:
    """In a task: the words with A-Z in lower case, as UTF-8."""
    return text.encode().lower().split()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` puts it into a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def with_new(df: DataFrame, **new: Column) -> DataFrame:
    """``df`` without internal columns, then ``new``; a new column takes the place of an input's of that name."""
    names = {n.lower() for n in new}
    old = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names and not c.startswith(OWN)]
    return df.select(*old, *[c.alias(n) for n, c in new.items()])


def same(names: dict[str, str]) -> Column:
    """Join condition: pairs of columns are equal, or both null."""
    out = F.lit(True)
    for a, b in names.items():
        out &= F.col(a).eqNullSafe(F.col(b))
    return out


@contextmanager
def rows_in_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that are run inside hand at most so many rows at a time to Python; for rows that may be large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
