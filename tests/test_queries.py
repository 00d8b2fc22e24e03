import pytest
from conftest_oracle import compare, connect

from lakeline.plans import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    compare(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], DIR, con)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() >= 0
