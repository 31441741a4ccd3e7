"""Stack car tables, clean the keys, merge mileage by key, pick and sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepframe.functions.scalars import strip
from stepframe.operators.joins import match_merge
from stepframe.operators.sets import set_concat


def cars_job(cars: Sequence[DataFrame], mileage: DataFrame, order_cars: Sequence[str],
             order_mileage: Sequence[str], keys: Sequence[str] = ("make", "model"),
             choice: Column | None = None, sort: Sequence[Column] | None = None,
             hot_rows: int | None = None) -> DataFrame:
    """European SUVs, cheapest first and highest mileage first among equals.

    Keys are stripped on both sides.  The order columns fix the row order inside a key group.
    No sort is needed before the merge; only the result is sorted.
    """
    clean = {k: strip(k) for k in keys}
    stacked = set_concat(list(cars)).withColumns(clean)
    merged = match_merge([(stacked, order_cars), (mileage.withColumns(clean), order_mileage)],
                         keys, hot_rows=hot_rows)
    if choice is None:
        choice = (F.col("origin") == "Europe") & (F.col("type") == "SUV")
    if sort is None:
        sort = [F.col("msrp").asc(), F.col("mpg_highway").desc()]
    return merged.where(choice).orderBy(*sort)
