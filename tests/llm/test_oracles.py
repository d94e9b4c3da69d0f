"""Queries that SQL can state give what their SQL gives."""

from __future__ import annotations

import pytest

from compare import compare, connect
from waybill.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


class Stated:
    def __init__(self, name):
        self.name, self.sql = name, ORACLES[name]

    def __call__(self, spark, folder):
        return QUERIES[self.name](spark, folder)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    assert compare(Stated(name), spark, FOLDER, con)[0] == "ok"


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
