"""Queries with SQL against their SQL, on the whole small tables."""

import pytest
from oracle import compare

from pulsegrid.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, tables, name):
    assert compare(spark, tables, name, QUERIES[name], ORACLES[name]) is None


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
