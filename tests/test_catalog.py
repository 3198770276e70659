import pytest
from oracle import connect, differences

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = connect(SF)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    assert differences(QUERIES[name](spark, SF), duck, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_twin_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_shows_both_cohorts(spark):
    assert {row.label for row in entry(spark).collect()} == {"matched", "unmatched"}
