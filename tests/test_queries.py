"""Every registered query against its SQL on the smallest data; queries without SQL must return rows."""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["chunk_id", "series_id", "abs_ep", "score"] and rows.count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    _, _, verdict = compare(spark, con, SF_DIR, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert verdict.startswith(("ok", "rows only")), verdict
