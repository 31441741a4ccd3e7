"""All registered queries of the subpackage."""

from stepframe.llm import queries_mining, queries_native, queries_text  # noqa: F401  (importing registers the queries)
from stepframe.llm.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
