"""Every registered query against its DuckDB SQL, on the smallest scale."""

import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry
from spanguard.plans import catalog

QUERIES, SQL = catalog.QUERIES, catalog.SQL


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_all_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert set(entry.entry(spark).columns) == {"decision", "entity_type", "n"}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf, name):
    assert compare(spark, con, name, QUERIES[name], SQL.get(name), sf) is None
