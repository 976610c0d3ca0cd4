"""Every catalogue query equals its SQL."""

import pytest

from shelfworks.plans import registry
from tests.oracle import connection, rows_in_sql, rows_of


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert rows_of(registry.QUERIES[name](spark, sf_dir)) == rows_in_sql(con, registry.ORACLE[name])


def test_entry_point_imports():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
