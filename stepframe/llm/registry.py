"""Queries of the subpackage, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The query functions themselves; tests give them tables of their own.
FUNCTIONS: dict[str, Callable[[Callable[[str], DataFrame]], DataFrame]] = {}


def query(key: str, sql: str | None = None):
    """Register ``fn(table)`` under ``key``; ``table(name)`` reads a table of the data folder."""

    def register(fn: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[key] = lambda spark, folder: fn(lambda name: spark.read.parquet(f"{folder}/{name}.parquet"))
        FUNCTIONS[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register
