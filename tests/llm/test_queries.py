"""Registered queries against their SQL, and the guard around the subpackage."""

import pytest

from stepframe.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_sql(spark, key):
    from tools.check_oracles import compare, connect
    _, types = compare(QUERIES[key](spark, FOLDER), connect(FOLDER), ORACLES[key])
    assert not types


def test_every_operator_has_a_query():
    assert [sum(k.startswith(f"op{n}_") for k in QUERIES) for n in range(1, 14)] == [1] * 13


def test_entry_registers_all():
    import __spark_entry__ as entry
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
