"""Every registered query against its DuckDB statement on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = connect(SF_DIR)
    con.execute("SET TimeZone='UTC'")
    return con


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare(df, duck, sql) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["lang", "category", "source", "n_spans", "n_values"]


def test_statements_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
