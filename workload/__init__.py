"""Registered queries on the driver tables, each with the equivalent SQL where there is one."""

from workload.registry import ORACLES, QUERIES

from workload import (  # noqa: F401  (importing registers the queries)
    artifacts,
    joins,
    loads,
    ordered,
    rows,
    scalars,
    sources,
    streams,
    summaries,
)

__all__ = ["QUERIES", "ORACLES"]
