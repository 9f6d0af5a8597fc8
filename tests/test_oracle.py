"""Every query against its SQL; queries without SQL must give rows."""

import os

import pytest

import __spark_entry__ as registered
from compare import compare, connect

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registered.queries(), registered.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, SQL[name]) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    found = registered.entry(spark)
    assert found.columns == ["n", "n_unknown", "file", "start_time", "kind", "pos", "value"] or set(
        found.columns
    ) == {"n", "n_unknown", "file", "start_time", "kind", "pos", "value"}
    assert found.count() > 0


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)
