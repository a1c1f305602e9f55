import pytest
from oracle import compare

from __spark_entry__ import entry, oracle_sql, queries

SQL = oracle_sql()


def test_contract(spark):
    assert set(SQL) <= set(queries())
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, tables, name):
    assert compare(spark, tables, name, queries()[name], SQL[name]) is None


@pytest.mark.parametrize("name", ["pca_project", "kmeans", "gmm", "sklgmm", "mlkm", "merge_greedy", "merge_mutual", "scatter_2d"])
def test_query_gives_rows(spark, tables, name):
    assert queries()[name](spark, tables).count() > 0
