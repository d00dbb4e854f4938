"""Every query that SQL can express gives the rows of its SQL."""

import pytest

from quaylark import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(name, spark, sf_dir, duck, same):
    same(QUERIES[name](spark, sf_dir), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs_without_sql(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_every_sql_has_a_query():
    assert SQL.keys() <= QUERIES.keys()
