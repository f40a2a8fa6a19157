"""Every registered query with an oracle, against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import connect, differences
from paths import TINY

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(TINY)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    assert differences(QUERIES[name](spark, TINY), duck, ORACLES[name]) == []


def test_contract(spark):
    assert set(ORACLES) <= set(QUERIES)
    assert entry.entry(spark).columns[0] == "split"
