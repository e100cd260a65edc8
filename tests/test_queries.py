import pytest

from talus import catalog
from tests.oracle import same

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


def test_each_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_duckdb(spark, name):
    same(spark, QUERIES[name], ORACLE[name], "/root/testdata/sf0.001")
