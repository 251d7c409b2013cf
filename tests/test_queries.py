"""Every query with a SQL counterpart gives the same rows on the smallest tables."""

import pytest
from conftest import SMALL
from oracle_check import compare, connect

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, SMALL, name) == ""


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 2


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
