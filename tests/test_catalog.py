"""Every registered query against its SQL, or at least its rows, on the smallest tables."""

import pytest

from compare import oracle, same

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    spark.catalog.clearCache()
    assert same(QUERIES[name](spark, SF_DIR), oracle(SF_DIR, ORACLES[name])) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    spark.catalog.clearCache()
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert contract.entry(spark).count() == 7
