"""Every registered query against its SQL."""

import os

import __spark_entry__ as registered
import compare
import pytest

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = {n: q for n, q in registered.queries().items() if n not in registered.LLM_QUERIES}
SQL = {n: q for n, q in registered.oracle_sql().items() if n not in registered.LLM_SQL}


@pytest.fixture(scope="module")
def database():
    return compare.database(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, database, name):
    found = compare.of_spark(QUERIES[name](spark, SF_DIR))
    expected = compare.of_sql(database, SQL[name])
    assert found[0] == expected[0]
    assert found[1] == expected[1]


def test_entry(spark):
    result = registered.entry(spark)
    assert result.columns[:2] == ["rank", "maker"] and result.count() == 25
