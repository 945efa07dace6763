"""Every registered query runs, and equals its SQL twin where it has one."""

import pytest
from check import compare, connect

from shelfsift.queries import QUERIES, SQL, load_all

load_all()


@pytest.fixture(scope="session")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, folder, name):
    assert compare(QUERIES[name](spark, folder), duck, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
