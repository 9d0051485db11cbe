"""Every registered query against its SQL in DuckDB."""

import os

import pytest

import __spark_entry__ as entry
from curatorium.plans import load_all, registry
from tools.check import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
load_all()
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    status, _, _, detail = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert status == "OK", detail or "no SQL states what it must return"


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0
