"""The registered queries against their DuckDB SQL, on the smallest scale."""

import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry
from spanguard.llm import queries


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query(spark, sf, name):
    assert compare(spark, duck(sf), name, queries.QUERIES[name], queries.SQL[name], sf) is None


def test_all_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
