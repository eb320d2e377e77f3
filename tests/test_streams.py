"""State that streams carry from batch to batch: commits, merging, reviews, issues, and the whole event job."""

from __future__ import annotations

import datetime as dt
import os
import time

import pytest
from compare import bag, compare, duck
from pyspark.sql import functions as F

from tracewright.schemas import BLOCKER_LABEL
from tracewright.streaming import job, reviews
from tracewright.streaming.ledger import append_comments, ledger_tables
from tracewright.streaming.tables import BatchTables
from tracewright.workloads import events
from tracewright.workloads.base import t

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DAY = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def rows_of(spark, root, name, schema, columns):
    return sorted(tuple(r) for r in BatchTables(spark, str(root)).read(name, schema).select(*columns).collect())


def folders(root) -> list[str]:
    return [os.path.join(d, x) for d, dirs, _ in os.walk(root) for x in dirs if "-" in x]


def test_many_batches_leave_few_folders(spark, tmp_path):
    def batch(n):
        return spark.createDataFrame([(k, n, f"{n}.{k}") for k in range(n % 4 + 1)], "k long, n int, v string").coalesce(1)

    reduce = {"keyed": lambda rows: rows.groupBy("k").agg(F.max("n").alias("n"), F.max_by("v", "n").alias("v"))}
    root, fan, count = str(tmp_path / "t"), 3, 30
    for n in range(count):
        tables = BatchTables(spark, root, n, reduce, fan)
        assert not tables.done
        for name in ("all", "keyed", "once"):
            tables.save(batch(n), name)
        tables.commit(("all", "keyed"))
        assert len(folders(root)) <= 2 * (fan * 4 + fan) + 3
    assert len(os.listdir(f"{root}/_commits")) <= 2 * 3  # markers and their checksums
    assert BatchTables(spark, root, 7, reduce, fan).done is False  # long gone, but Spark asks for the last batch at most
    assert BatchTables(spark, root, count - 1, reduce, fan).done
    last = BatchTables(spark, root, None, reduce)
    schema = batch(0).schema
    assert sorted(map(tuple, last.read("all", schema).collect())) == sorted((k, n, f"{n}.{k}") for n in range(count) for k in range(n % 4 + 1))
    assert sorted(map(tuple, last.read("keyed", schema).collect())) == [(k, n, f"{n}.{k}") for k, n in ((0, 29), (1, 29), (2, 27), (3, 27))]
    assert {r["n"] for r in last.read("once", schema).collect()} == {count - 1}


def test_ledger_ids_stay_when_folders_merge(spark, tmp_path):
    columns = "at timestamp, n bigint, username string, command_name string, comment_url string, subject_url string, comment_text string, name string, email string, avatar_url string"
    batch = lambda n: spark.createDataFrame([(DAY, 2 * n + k, f"u{(n + k) % 5}", "blame", f"c/{2 * n + k}", "", "", "", "", "") for k in (0, 1)], columns)
    for n in range(7):
        append_comments(batch(n), n, str(tmp_path), ["at", "n"], fan=2)
        append_comments(batch(n), n, str(tmp_path), ["at", "n"], fan=2)
    users, logs = ledger_tables(spark, str(tmp_path))
    assert [tuple(r) for r in logs.orderBy("id").select("id", "comment_url").collect()] == [(i + 1, f"c/{i}") for i in range(14)]
    assert [tuple(r) for r in users.orderBy("id").select("id", "username").collect()] == [(i + 1, f"u{i}") for i in range(5)]


def requests(spark, rows):
    return spark.createDataFrame([("r", pr, n, DAY, sha, forced) for pr, n, sha, forced in rows], "repo_id string, pull_request_id long, event_id long, ts timestamp, head_sha string, forced boolean")


def store(spark, root, batch, f, reduce=reviews.REDUCE):
    tables = BatchTables(spark, str(root), batch, reduce)
    if not tables.done:
        f(tables)
        tables.commit(reviews.KEPT)


def test_review_state_over_batches(spark, tmp_path):
    first = requests(spark, [(1, 2, "b", False), (1, 1, "a", False), (1, 3, "b", False), (1, 4, "b", True), (1, 5, "", False), (2, 1, "z", False)])
    second = requests(spark, [(1, 6, "b", False), (1, 7, "a", False), (1, 8, "a", True)])
    for n, rows in ((0, first), (0, first), (1, second), (1, second)):
        store(spark, tmp_path, n, lambda t: reviews.store_reviews(t, rows))
    assert rows_of(spark, tmp_path, "due", reviews.DUE, ["pull_request_id", "event_id", "since_sha"]) == sorted(
        [(1, 1, None), (1, 2, "a"), (1, 4, None), (1, 7, "b"), (1, 8, None), (2, 1, None)], key=lambda r: (r[0], r[1])
    )


def test_a_batch_that_failed_leaves_no_trace(spark, tmp_path):
    rows = requests(spark, [(1, 1, "a", False)])
    tables = BatchTables(spark, str(tmp_path), 0, reviews.REDUCE)
    reviews.store_reviews(tables, requests(spark, [(1, 1, "other", False), (9, 1, "x", False)]))  # ends before its commit
    assert BatchTables(spark, str(tmp_path)).read("due", reviews.DUE).count() == 0
    store(spark, tmp_path, 0, lambda t: reviews.store_reviews(t, rows))
    assert rows_of(spark, tmp_path, "due", reviews.DUE, ["pull_request_id", "head_sha"]) == [(1, "a")]


def test_a_change_with_most_of_a_batch(spark, tmp_path):
    rows = [(1 if n % 3 else n, n, f"s{n // 7 % 5}", n % 11 == 0) for n in range(3000)]
    store(spark, tmp_path, 0, lambda t: reviews.store_reviews(t, requests(spark, rows[:2000]).repartition(6)))
    store(spark, tmp_path, 1, lambda t: reviews.store_reviews(t, requests(spark, rows[2000:])))
    last: dict = {}
    want = []
    for pr, n, sha, forced in rows:
        if forced or last.get(pr) != sha:
            want.append((n, None if forced else last.get(pr)))
        last[pr] = sha
    found = BatchTables(spark, str(tmp_path)).read("due", reviews.DUE).orderBy("event_id").collect()
    assert [(r["event_id"], r["since_sha"]) for r in found] == want
    assert not any("Pandas" in x or "Python" in x for x in [BatchTables(spark, str(tmp_path)).read("due", reviews.DUE)._jdf.queryExecution().toString()])


def test_issues_are_processed_once_and_only_by_success(spark, tmp_path):
    have = {1: [5, 6], 2: []}
    asked = []

    def rank(issues):
        asked.append(sorted(r["issue_id"] for r in issues.collect()))
        return spark.createDataFrame([("r", i, c) for i, c in have.items()], "repo_id string, issue_id long, culprits array<long>").join(issues, ["repo_id", "issue_id"], "left_semi")

    def batch(*rows):
        columns = "repo_id string, issue_id long, event_id long, ts timestamp, labels array<string>"
        return spark.createDataFrame([("r", i, n, DAY, [BLOCKER_LABEL] if labelled else labels) for i, n, labelled, labels in rows], columns)

    first = batch((1, 1, False, ["bug"]), (1, 2, False, None), (2, 3, True, None), (2, 4, True, None))
    second = batch((1, 5, False, []), (1, 6, True, None), (1, 7, True, None), (1, 8, False, []), (2, 9, True, None))
    third = batch((1, 10, True, None), (1, 11, False, []), (2, 12, True, None), (3, 13, True, None))
    store(spark, tmp_path, 0, lambda t: reviews.store_issues(t, first, rank))
    store(spark, tmp_path, 1, lambda t: reviews.store_issues(t, second, rank))
    have[2] = [8]
    store(spark, tmp_path, 2, lambda t: reviews.store_issues(t, third, rank))
    done, open_, none, over = "processed", "not labeled", "no culprits", "already processed"
    assert rows_of(spark, tmp_path, "verdicts", reviews.VERDICTS, ["event_id", "verdict"]) == [
        (1, open_), (2, open_), (3, none), (4, none), (5, open_), (6, done), (7, over), (8, over), (9, none), (10, over), (11, over), (12, done), (13, none),
    ]
    assert [x for x in asked] == [[2], [1, 2], [2, 3]]
    assert rows_of(spark, tmp_path, "processed", reviews.PROCESSED, ["issue_id", "event_id", "culprits"]) == [(1, 6, [5, 6]), (2, 12, [8])]


@pytest.fixture(scope="module")
def cut_events(spark, tmp_path_factory):
    """The events table as four files in order of time."""
    inbox = tmp_path_factory.mktemp("inbox")
    rows = t(spark, FOLDER, "events").toPandas().sort_values(["ts", "event_id"])
    size = -(-len(rows) // 4)
    for n in range(4):
        rows.iloc[n * size : (n + 1) * size].to_parquet(inbox / f"{n}.parquet", coerce_timestamps="us")
        os.utime(inbox / f"{n}.parquet", (time.time() - 100 + n, time.time() - 100 + n))
    return str(inbox)


def test_event_job_over_batches(spark, cut_events, tmp_path):
    stream = spark.readStream.schema(t(spark, FOLDER, "events").schema).option("maxFilesPerTrigger", 1).parquet(cut_events)
    comments = events._job_comments(stream.withColumn("ts", F.col("ts").cast("timestamp")))
    root = str(tmp_path / "job")
    job.comment_event_job(comments, root, events._ranker(spark, FOLDER), fan=2).awaitTermination()
    assert BatchTables(spark, root, 3).done
    assert compare(job.outcomes(spark, root), duck(FOLDER), events.JOB_SQL) is None
    one = events.comment_event_job(spark, FOLDER)
    rows = one.collect()
    assert {r["outcome"] for r in rows} >= {"review", "skip", "processed", "already processed", "not labeled", "unknown"}
    assert bag(rows, one.columns) == bag(job.outcomes(spark, root).collect(), one.columns)
