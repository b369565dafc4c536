"""Every query of the advisor against DuckDB on the same tables."""

from __future__ import annotations

import pytest

from ledgerloom.plans import registry
from tests.compare import assert_same, duck

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, small, con, name):
    assert_same(QUERIES[name](spark, small), con, SQL[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
