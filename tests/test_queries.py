"""Every registered query against its SQL on the smallest driver tables."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect
from checks.oracle import ORACLE_SQL
from checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE_SQL.keys()
    assert QUERIES.keys() <= entry.queries().keys() and ORACLE_SQL.keys() <= entry.oracle_sql().keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    equal, rows, _, _, difference = compare(spark, db, SF_DIR, name)
    assert equal, difference
    assert rows > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["category", "month", "gross_revenue", "returned_orders"]
