"""Every core query against its SQL; queries without SQL must give rows."""

import os

import duckdb
import parity
import pytest

from quern.plans import data_queries, link_queries, registry, search_queries  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    parity.tables(c, FOLDER)
    return c


@needs_data
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, con, name):
    assert parity.compare(spark, con, registry.QUERIES[name], registry.ORACLES[name], FOLDER) is None


@needs_data
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).limit(1).count() == 1
