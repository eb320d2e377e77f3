"""State over review and ranking requests, carried from batch to batch in tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tracewright.functions.core import blank_to_null
from tracewright.operators import gates
from tracewright.operators.state import ISSUE, PULL, one_per_key
from tracewright.schemas import BLOCKER_LABEL, BOOL, LONG, STR, TS, record
from tracewright.streaming.ledger import in_batches
from tracewright.streaming.tables import FAN, BatchTables

AT = ["ts", "event_id"]
DUE = record(repo_id=STR, pull_request_id=LONG, event_id=LONG, ts=TS, head_sha=STR, since_sha=STR, forced=BOOL)
REVIEWED = record(repo_id=STR, pull_request_id=LONG, ts=TS, event_id=LONG, head_sha=STR)
PROCESSED = record(repo_id=STR, issue_id=LONG, ts=TS, event_id=LONG, culprits=T.ArrayType(LONG))
VERDICTS = record(repo_id=STR, issue_id=LONG, event_id=LONG, verdict=STR)
REDUCE = {"reviewed": lambda rows: one_per_key(rows, PULL, AT)}
KEPT = ("reviewed", "due", "processed", "verdicts")

#: Ranks the requested issues: takes (repo_id, issue_id) and gives (repo_id, issue_id, culprits) of those it found culprits for.
Ranker = Callable[[DataFrame], DataFrame]


def store_reviews(tables: BatchTables, requests: DataFrame) -> DataFrame:
    """The requests of one batch that need a review: the head moved since the last one, or the request is forced.

    ``requests`` has repo_id, pull_request_id, event_id, ts, head_sha and forced. The commit each change was last reviewed at stands before the
    batch's rows in one range-sorted table, where every request looks at the row before it; so no group sits in one task, however
    many requests one change brings. ``since_sha`` is the commit to review from, null for a whole review.
    """
    valid = requests.filter(blank_to_null(F.col("head_sha")).isNotNull()).select("repo_id", "pull_request_id", "event_id", "ts", "head_sha", "forced")
    valid = tables.save(valid, "review_requests")
    last = tables.read("reviewed", REVIEWED).join(valid.select(*PULL).distinct(), PULL, "left_semi")
    first = F.timestamp_seconds(F.lit(-62135596800)).alias("ts")  # before any event
    stored = last.select(*PULL, F.lit(0).cast("long").alias("event_id"), first, "head_sha", F.lit(False).alias("forced"), F.lit(True).alias("stored"))
    rows = valid.withColumn("stored", F.lit(False)).unionByName(stored)
    due = tables.save(gates.due_reviews(rows).where("NOT stored").select(*DUE.names), "due")
    newest = valid.groupBy(*PULL).agg(F.max(F.struct(*AT, "head_sha")).alias("n"))
    tables.save(newest.select(*PULL, "n.*").select(*REVIEWED.names), "reviewed")
    return due


def store_issues(tables: BatchTables, requests: DataFrame, rank: Ranker, label: str = BLOCKER_LABEL) -> DataFrame:
    """Verdicts on the ranking requests of one batch; an issue counts as processed only once culprits were found for it.

    ``requests`` has repo_id, issue_id, event_id, ts and the labels the tracker had at that time. Of an issue that is still open the first
    labelled request is ranked. If it brings culprits, later requests find the issue processed; if not, or if the label is missing,
    the issue stays open for later batches. All of it meets by issue, with one row for each issue on one side.
    """
    labelled = F.coalesce(F.array_contains("labels", label), F.lit(False)).alias("labelled")
    requests = tables.save(requests.select("repo_id", "issue_id", *AT, labelled), "issue_requests")
    done = tables.read("processed", PROCESSED).select(*ISSUE, F.lit(True).alias("done"))
    asked = requests.join(done, ISSUE, "left")
    first = asked.where("labelled AND done IS NULL").groupBy(*ISSUE).agg(F.min(F.struct(*AT)).alias("first"))
    first = tables.save(first, "ranked")
    found = rank(first.select(*ISSUE)).where(F.size("culprits") > 0).select(*ISSUE, "culprits")
    found = tables.save(found.join(first, ISSUE).select(*ISSUE, "first.*", "culprits"), "processed")
    now = asked.join(found.select(*ISSUE, F.struct(*AT).alias("success")), ISSUE, "left")
    verdict = (
        F.when(F.col("done") | (F.struct(*AT) > F.col("success")), "already processed")
        .when(~F.col("labelled"), "not labeled")
        .when(F.col("success").isNotNull(), "processed")
        .otherwise("no culprits")
    )
    return tables.save(now.select(*ISSUE, "event_id", verdict.alias("verdict")), "verdicts")


def _batch(spark, root: str, batch_id: int, fan: int, store) -> None:
    tables = BatchTables(spark, root, batch_id, REDUCE, fan)
    if not tables.done:
        store(tables)
        tables.commit(KEPT)


def review_stream(requests: DataFrame, root: str, fan: int = FAN) -> StreamingQuery:
    """Run the review state over all requests available now; ``due`` under ``root`` holds those that need a review."""
    return in_batches(requests, root, lambda df, n: _batch(df.sparkSession, root, n, fan, lambda t: store_reviews(t, df)))


def issue_stream(requests: DataFrame, root: str, rank: Ranker, fan: int = FAN) -> StreamingQuery:
    """Run process-once over all requests available now; ``verdicts`` and ``processed`` under ``root`` hold the outcome."""
    return in_batches(requests, root, lambda df, n: _batch(df.sparkSession, root, n, fan, lambda t: store_issues(t, df, rank)))
