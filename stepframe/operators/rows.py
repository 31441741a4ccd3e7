"""Row-level operators: routing, defaults and domain checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepframe.functions.rules import in_domain

# The allowed states and kinds of the job-tracking tables.
PROJECT_STATUS = ("analyzing", "ready", "converting", "reviewing", "completed")
TASK_STATUS = ("pending", "converting", "converted", "reviewed", "approved")
SOURCE_TYPE = ("sas-code", "sas-eg")
TARGET_TYPE = ("sql", "pyspark")


def route_rows(df: DataFrame, delete_when: Column, routes: dict[str, tuple[Column, Column]],
               out: str = "route") -> DataFrame:
    """Drop rows that meet a condition and label the others with the output they go to.

    ``routes`` maps an output name to (condition, command text); the first match wins, other
    rows go to 'main' without a command.  Conditions that are NULL count as false.
    """
    kept = df.where(~F.coalesce(delete_when, F.lit(False)))
    label = command = F.when(F.lit(False), F.lit(""))
    for name, (condition, text) in routes.items():
        label = label.when(condition, F.lit(name))
        command = command.when(condition, text)
    return kept.withColumns({out: label.otherwise(F.lit("main")), "command": command})


def declare_defaults(df: DataFrame, declared: dict[str, tuple[int, str]]) -> DataFrame:
    """Text columns with a declared length and a start value.

    ``declared`` maps a column to (length, start value).  A column that the table has takes the
    table's values, cut to the length (a missing one is blank); others get the start value.
    """
    new = {}
    for name, (length, start) in declared.items():
        value = F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit(start)
        new[name] = F.left(value, F.lit(length))
    return df.withColumns(new)


def enum_domain_check(df: DataFrame, domains: dict[str, Sequence[str]]) -> DataFrame:
    """Add ``valid`` and ``reason`` (the first column with a value outside its domain)."""
    reason = F.when(F.lit(False), F.lit(""))
    for name, domain in domains.items():
        reason = reason.when(~in_domain(name, domain), F.lit(f"invalid {name}"))
    return df.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())
