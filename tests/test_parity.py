"""Every query that SQL can express equals its SQL on DuckDB, value by value."""

from __future__ import annotations

import parity
import pytest

import __spark_entry__ as contract

SQL = contract.oracle_sql()
PLANS = contract.queries()


@pytest.fixture(scope="module")
def con(sf):
    return parity.duck(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, sf, name):
    report = parity.compare(spark, con, sf, name, PLANS[name], SQL[name])
    assert report.startswith("ok"), report


def test_every_sql_has_a_query():
    assert set(SQL) <= set(PLANS)


def test_entry_runs(spark):
    assert contract.entry(spark).count() == 5
