"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from compare import connect, difference
from helpers import TINY

import __spark_entry__ as contract
from gamelog import oracle, queries

# The training-data queries have tests of their own.
TWINS = oracle.oracle_sql()
QUERIES = queries.registered()


@pytest.fixture(scope="module")
def duck():
    return connect(TINY)


def test_every_twin_has_a_query():
    assert set(TWINS) <= set(QUERIES)
    assert set(QUERIES) <= set(contract.queries()) and set(TWINS) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", [n for n in QUERIES if n in TWINS])
def test_query(spark, duck, name):
    assert difference(QUERIES[name](spark, TINY), duck, TWINS[name]) is None


def test_entry(spark):
    assert contract.entry(spark).count() == 20
