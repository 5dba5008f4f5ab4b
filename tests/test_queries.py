"""Every query of the core against its SQL, on the smallest tables."""

import pytest

from oracle import compare, connect
from tidelog.plans import catalogue

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    rows, missing, surplus = compare(spark, QUERIES[name], SQL[name], SMALL, con)
    assert (missing, surplus) == (0, 0)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
