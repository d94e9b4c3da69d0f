"""Every registered query gives what its SQL gives on the smallest tables."""

from __future__ import annotations

import os

import pytest

from compare import compare, connect
from workload import load_all

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    verdict, _ = compare(QUERIES[name], spark, SF_DIR, con)
    assert verdict == "ok"


def test_every_query_has_sql():
    assert [n for n, q in QUERIES.items() if not q.sql] == []


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    result = entry.entry(spark)
    assert result.count() > 0
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())
