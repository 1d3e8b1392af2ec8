"""Every query with a SQL statement of its result, on the smallest data set."""

import pytest
from compare import difference, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


# states a t value that holds when every test has a run on each of the 30 days
NEEDS_ALL_DAYS = {"met_12_mean_interval"}


@pytest.mark.parametrize("name", [n for n in SQL if n not in NEEDS_ALL_DAYS])
def test_matches_sql(spark, con, name):
    assert difference(entry.queries()[name](spark, SF), con, SQL[name]) is None


def test_every_sql_has_its_query():
    assert set(SQL) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert not entry.entry(spark).isEmpty()
