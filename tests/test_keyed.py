"""Keyed tables in buckets: what a write touches, versions, and what is removed with what."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tracewright.operators import state
from tracewright.schemas import LONG, STR, record
from tracewright.sources.keyed import KeyedTable

SCHEMA = record(repo_id=STR, id=LONG, v=STR)


def rows(spark, items):
    return spark.createDataFrame([("r", i, v) for i, v in items], SCHEMA)


def files(root) -> dict[str, float]:
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def content(table, version=None):
    return {r["id"]: r["v"] for r in table.read(version).collect()}


def test_writes_touch_their_buckets_only(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), SCHEMA, ["repo_id", "id"], buckets=8)
    assert content(table) == {} and table.version() == -1
    table.replace(rows(spark, [(i, "old") for i in range(100)]))
    before, folders = files(tmp_path), table._folders(0)
    assert len(folders) == 8
    table.replace(rows(spark, [(3, "new"), (1000, "more")]))
    after = files(tmp_path)
    assert {f: after[f] for f in before} == before  # nothing that was there is written again
    assert sum(table._folders(1)[b] == v for b, v in folders.items()) >= 6  # all but the buckets of two keys
    assert len(set(after) - set(before)) <= 2
    want = {i: "old" for i in range(100)} | {3: "new", 1000: "more"}
    assert content(table) == want and content(table, 0)[3] == "old"
    table.update(rows(spark, [(4, "set"), (5000, "nobody")]), ["v"])
    table.delete(rows(spark, [(i, None) for i in range(50, 60)]))
    want = {i: v for i, v in (want | {4: "set"}).items() if not 50 <= i < 60}
    assert content(table) == want
    table.expire(1)
    assert content(table) == want and table.manifest.versions() == [3]
    table.replace(rows(spark, [(4, "b"), (4, "a")]))
    assert table.read().where("id = 4").count() == 1


def test_an_empty_bucket_goes(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), SCHEMA, ["repo_id", "id"], buckets=4)
    table.replace(rows(spark, [(1, "a")]))
    table.delete(rows(spark, [(1, None)]))
    assert content(table) == {} and table._folders(1) == {}
    table.replace(rows(spark, []))
    assert content(table) == {}


def test_two_writers_of_one_version(spark, tmp_path):
    one, other = (KeyedTable(spark, str(tmp_path), SCHEMA, ["repo_id", "id"], buckets=4) for _ in range(2))
    one.replace(rows(spark, [(1, "a")]))
    with pytest.raises(OSError):
        other.manifest.put(0, {"buckets": {}})
    assert content(other) == {1: "a"}


def test_cascade_follows_the_foreign_keys(spark):
    frame = lambda cells, columns: spark.createDataFrame(cells, columns)
    tables = {
        "c": frame([(1, 1), (2, 2), (3, 9)], "id long, b_id long"),
        "b": frame([(1, 1), (2, 7)], "id long, a_id long"),
        "a": frame([(1,), (2,)], "id long"),
        "n": frame([(1, 1), (2, 5)], "id long, a_id long"),
    }
    keys = (("c", {"b_id": "id"}, "b", None), ("b", {"a_id": "id"}, "a", None), ("n", {"a_id": "id"}, "a", "a_id"))
    now = state.with_integrity(tables, keys)
    assert list(now) == list(tables)
    assert [sorted(tuple(r) for r in now[n].collect()) for n in "cbn"] == [[(1, 1)], [(1, 1)], [(1, 1), (2, None)]]
    users = {"users": frame([(1,), (2,)], "id long"), "usage_logs": frame([(5, 1), (6, 2)], "id long, user_id long"), "llm_calls": frame([(6,), (5,), (5,)], "usage_log_id long")}
    left = state.delete_cascade(users, "users", users["users"].where(F.col("id") == 1))
    assert [left[n].count() for n in users] == [1, 1, 1]
