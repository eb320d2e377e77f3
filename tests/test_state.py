"""Keyed tables, ledgers and reports."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracewright.operators import delivery, ledger, state
from tracewright.schemas import (
    ISSUE_EMBEDDINGS,
    ISSUE_PULL_REQUEST,
    ISSUES,
    MODEL_CALLS,
    PULL_REQUEST_EMBEDDINGS,
    PULL_REQUEST_REVIEWS,
    PULL_REQUESTS,
    USAGE_LOGS,
    USERS,
)

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def now():
    return F.lit("2025-05-05 00:00:00").cast("timestamp")


def table(spark, schema, *rows):
    names = schema.names
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def test_replacing_a_change_resets_and_cascades(spark, now):
    pulls = table(spark, PULL_REQUESTS, dict(id=1, repo_id="r", title="old", test="t", linked_issue_ids=[3]), dict(id=1, repo_id="{uuid}", title="other"))
    vectors = table(spark, PULL_REQUEST_EMBEDDINGS, dict(pull_request_id=1, repo_id="r", embedding=[1.0]))
    links = table(spark, ISSUE_PULL_REQUEST, *[dict(issue_id=9, pull_request_id=1, repo_id=x, score=0.5) for x in ("r", "{uuid}")])
    rows = spark.createDataFrame([(1, "r", "new", [2.0])], "id bigint, repo_id string, title string, embedding array<double>")
    p, e, k = state.upsert_pull_requests(pulls, vectors, links, rows, now)
    got = {r["repo_id"]: r for r in p.collect()}
    assert (got["r"]["title"], got["r"]["test"], got["r"]["linked_issue_ids"]) == ("new", None, None)
    assert got["r"]["created_at"] == dt.datetime(2025, 5, 5) and got["{uuid}"]["title"] == "other"
    assert [r["embedding"] for r in e.collect()] == [[2.0]]
    assert [r["repo_id"] for r in k.collect()] == ["{uuid}"]


def test_replacing_a_processed_issue(spark, now):
    issues = table(spark, ISSUES, dict(id=1, repo_id="r", title="a", is_processed=True, culprit_pull_requests=[(2, "x")], actual_pull_request_id=2))
    vectors = table(spark, ISSUE_EMBEDDINGS, dict(issue_id=1, repo_id="r", embedding=[1.0]))
    links = table(spark, ISSUE_PULL_REQUEST, dict(issue_id=1, pull_request_id=2, repo_id="r", score=0.5))
    rows = spark.createDataFrame([(1, "r", "b", [2.0])], "id bigint, repo_id string, title string, embedding array<double>")
    i, e, k = state.upsert_issues(issues, vectors, links, rows, now)
    row = i.first()
    assert (row["is_processed"], row["culprit_pull_requests"], row["actual_pull_request_id"]) == (False, None, None)
    assert e.first()["embedding"] == [2.0] and k.count() == 0


def test_links_need_their_change_and_are_kept_once(spark):
    pulls = table(spark, PULL_REQUESTS, dict(id=1, repo_id="r"), dict(id=2, repo_id="r"))
    links = table(spark, ISSUE_PULL_REQUEST, dict(issue_id=9, pull_request_id=1, repo_id="r", score=0.7))
    wanted = spark.createDataFrame([(9, 1, "r"), (9, 2, "r"), (9, 2, "r"), (9, 3, "r")], "issue_id bigint, pull_request_id bigint, repo_id string")
    assert [tuple(r) for r in state.new_links(links, wanted, pulls).collect()] == [(9, 2, "r", 0.0)]


def test_updates_touch_existing_rows_only(spark):
    links = table(spark, ISSUE_PULL_REQUEST, *[dict(issue_id=9, pull_request_id=p, repo_id="r", score=0.0) for p in (1, 2, 3)])
    scores = spark.createDataFrame([("r", 9, 1, 0.5), ("r", 9, 2, None), ("r", 9, 4, 0.9)], "repo_id string, issue_id bigint, pull_request_id bigint, score double")
    got = {r["pull_request_id"]: r["score"] for r in state.set_scores(links, scores).collect()}
    assert got == {1: 0.5, 2: None, 3: 0.0}


def test_first_appearance_makes_the_user(spark, now):
    users = table(spark, USERS, dict(id=4, username="ann", name="Ann", avatar_url="", is_active=True))
    seen = spark.createDataFrame(
        [("bob", "B2", 3, 7), ("ann", "X", 1, 5), ("bob", "B1", 2, 6), ("cy", "C", 2, 8)], "username string, name string, at int, n int"
    )
    got = state.new_users(users, seen, ["at", "n"], 5, now).orderBy("id").collect()
    assert [(r["id"], r["username"], r["name"], r["is_active"]) for r in got] == [(5, "bob", "B1", True), (6, "cy", "C", True)]


def test_review_watermark(spark, now):
    reviews = table(spark, PULL_REQUEST_REVIEWS, dict(pull_request_id=1, repo_id="r", last_reviewed_commit_sha="a", updated_at=T0))
    done = spark.createDataFrame([(1, "r", "b"), (1, "{u}", "c")], "pull_request_id bigint, repo_id string, last_reviewed_commit_sha string")
    got = {r["repo_id"]: (r["last_reviewed_commit_sha"], r["updated_at"]) for r in state.record_reviews(reviews, done, now).collect()}
    assert got == {"r": ("b", dt.datetime(2025, 5, 5)), "{u}": ("c", dt.datetime(2025, 5, 5))}


def test_migrations(spark):
    old = {
        "usage_logs": spark.createDataFrame([(1,)], "id bigint"),
        "llm_calls": spark.createDataFrame([(1, 2)], "id bigint, cost_usd_cents bigint"),
        "pull_requests": spark.createDataFrame([(1, "e")], "id bigint, explaination string"),
        "test_suite": spark.range(1),
    }
    now = state.migrate(old)
    assert {n: t.columns for n, t in now.items()} == {
        "usage_logs": ["id", "comment_text"],
        "llm_calls": ["id", "cost_usd_thousandths"],
        "pull_requests": ["id", "explanation", "linked_issue_ids"],
    }
    assert state.migrate(now, since=3)["pull_requests"].columns == now["pull_requests"].columns


def test_integrity(spark):
    tables = {
        "pull_requests": table(spark, PULL_REQUESTS, dict(id=1, repo_id="r")),
        "pull_request_embeddings": table(spark, PULL_REQUEST_EMBEDDINGS, *[dict(pull_request_id=i, repo_id="r") for i in (1, 2)]),
        "issues": table(spark, ISSUES, dict(id=5, repo_id="r", actual_pull_request_id=1), dict(id=6, repo_id="r", actual_pull_request_id=2)),
        "issue_embeddings": table(spark, ISSUE_EMBEDDINGS, *[dict(issue_id=i, repo_id="r") for i in (5, 7)]),
        "issue_pull_request": table(spark, ISSUE_PULL_REQUEST, *[dict(issue_id=i, pull_request_id=p, repo_id="r") for i, p in ((5, 1), (5, 2), (7, 1))]),
        "users": table(spark, USERS, dict(id=1)),
        "usage_logs": table(spark, USAGE_LOGS, dict(id=1, user_id=1), dict(id=2, user_id=2)),
        "llm_calls": table(spark, MODEL_CALLS, dict(id=1, usage_log_id=1), dict(id=2, usage_log_id=2)),
    }
    clean = state.with_integrity(tables)
    assert {n: t.count() for n, t in clean.items()} == {
        "pull_requests": 1, "pull_request_embeddings": 1, "issues": 2, "issue_embeddings": 1, "issue_pull_request": 1,
        "users": 1, "usage_logs": 1, "llm_calls": 1,
    }
    assert {r["id"]: r["actual_pull_request_id"] for r in clean["issues"].collect()} == {5: 1, 6: None}


def test_call_prices(spark):
    usage = "struct<input_tokens: bigint, output_tokens: bigint, output_token_details: struct<reasoning: bigint>>"
    df = spark.createDataFrame(
        [
            (1, "gpt-5-2025-08-07", (1001, 10, (5,))),
            (2, "gpt-5-nano-2025-08-07", (0, 0, None)),
            (3, "house", (9, 9, None)),
            (4, "gpt-5-mini-2025-08-07", None),
            (None, "gpt-5-2025-08-07", (1, 1, None)),
            (5, "gpt-5-2025-08-07", (800_000, 100_000, (None,))),
        ],
        f"usage_log_id bigint, llm_model string, usage_metadata {usage}",
    )
    got = {r["usage_log_id"]: (r["tokens_used"], r["cost_usd_thousandths"]) for r in ledger.price_calls(df).collect()}
    assert got == {1: (125 + 15, 1), 2: (0, 1), 5: (200_000, 2000)}
    assert {r["llm_model"]: r["calls"] for r in ledger.cost_by_model(ledger.price_calls(df)).collect()} == {
        "gpt-5-2025-08-07": 2, "gpt-5-nano-2025-08-07": 1,
    }


def test_nested_usage(spark):
    users = table(spark, USERS, dict(id=1, username="ann", name="A", avatar_url="", is_active=True))
    logs = table(spark, USAGE_LOGS, *[dict(id=i, user_id=u, command_name="blame", created_at=T0) for i, u in ((1, 1), (2, 1), (3, 9))])
    calls = table(spark, MODEL_CALLS, *[dict(id=i, usage_log_id=1, llm_model="m", tokens_used=i, cost_usd_thousandths=1) for i in range(7)])
    got = ledger.nested_usage(logs, users, calls, 3).orderBy("id", "chunk").collect()
    assert [(r["id"], r["chunk"], [c["id"] for c in r["llm_calls"]]) for r in got] == [
        (1, 0, [0, 1, 2]), (1, 1, [3, 4, 5]), (1, 2, [6]), (2, 0, []),
    ]
    assert got[0]["user"]["username"] == "ann" and got[0]["usage_log"]["command_name"] == "blame"
    totals = {r["id"]: r["tokens_used"] for r in ledger.usage_totals(logs, users, calls).collect()}
    assert totals == {1: 21, 2: 0}
    assert [r["id"] for r in ledger.newest_first(ledger.usage_totals(logs, users, calls)).collect()] == [2, 1]


def test_missing_keys_do_not_count(spark):
    rows = spark.createDataFrame([(1, "u", T0), (1, None, T0), (1, "u", None), (1, "u", T0)], "deploy_number bigint, deploy_url string, created_at timestamp")
    assert [tuple(r) for r in delivery.blockers_per_deploy(rows).collect()] == [(1, "u", T0, 2)]
    assert delivery.blockers_per_week(rows).first()["blockers"] == 3


def test_months_missing_on_one_side(spark):
    day = lambda m, n: [(i, dt.datetime(2025, m, 3)) for i in range(n)]
    merged = spark.createDataFrame(day(1, 3) + day(6, 2) + [(9, None)], "id int, date timestamp")
    fixes = spark.createDataFrame(day(1, 1) + day(2, 12) + day(6, 1), "id int, date timestamp")
    got = delivery.merged_and_fixes(merged, fixes).orderBy("month").collect()
    assert [(r["label"], r["merged"], r["fixes"], r["fix_hours"]) for r in got] == [
        ("Jan-2025", 3, 1, pytest.approx(1 / 12)), ("Feb-2025", 0, 12, pytest.approx(1.0)),
    ]


def test_a_task_is_not_given_many_packed_keys(spark):
    """Sequential keys pack to a few bytes a row; joined partitions must stay small for the tasks that sort them."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.parallelismFirst")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parents = spark.range(0, 2_000_000, 1, 8)
        children = spark.range(0, 4_000_000, 1, 8).withColumnRenamed("id", "parent")
        kept = state.drop_orphans(children, parents, {"parent": "id"})
        assert kept.rdd.getNumPartitions() > 1
        assert kept.count() == 2_000_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for k, v in before.items():
            spark.conf.set(k, v)
