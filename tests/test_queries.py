"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_file
from tidemark.plans import PLANS
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES = PLANS
SQL = {name: plan.sql for name, plan in PLANS.items()}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert all(SQL.values())
    assert set(QUERIES) <= set(entry_file.queries()) and set(SQL) <= set(entry_file.oracle_sql())


def test_entry(spark):
    assert entry_file.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, SQL[name]) is None
