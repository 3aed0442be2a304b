"""Every registered query equals its SQL at the smallest scale."""

from __future__ import annotations

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry
from notemill.plans import load

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load().QUERIES, load().ORACLES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    ok, note = compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert ok, note


def test_every_query_has_sql():
    assert sorted(QUERIES) == sorted(ORACLES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
