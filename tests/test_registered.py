"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import os

import pytest
from compare import compare, duck

import __spark_entry__ as registered
from tracewright.workloads import REGISTRY

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = {name: run for name, run in registered.queries().items() if name in REGISTRY}
ORACLE = {name: sql for name, sql in registered.oracle_sql().items() if name in REGISTRY}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    rows = QUERIES[name](spark, FOLDER)
    if name in ORACLE:
        assert compare(rows, con, ORACLE[name]) is None
    else:
        assert rows.count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert registered.entry(spark).columns == ["issue_id", "pull_request_id", "score", "rank"]
