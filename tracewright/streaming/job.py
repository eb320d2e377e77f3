"""The whole event job: comments in, and for each batch the ledger, the rankings and the reviews they ask for, committed together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewright.schemas import LONG, STR, USAGE_LOGS, record
from tracewright.streaming import ledger, reviews
from tracewright.streaming.tables import FAN, BatchTables

EVENTS = record(event_id=LONG, username=STR, comment_url=STR, route=STR)
REDUCE = {**ledger.REDUCE, **reviews.REDUCE}
KEPT = (*ledger.KEPT, *reviews.KEPT, "events")


def store_batch(comments: DataFrame, batch_id: int, root: str, rank: reviews.Ranker, fan: int = FAN) -> None:
    """One batch of projected comments through ledger, ranking and review.

    Besides the projected columns ``comments`` has event_id (unique), ts, the ``labels`` of its issue and the ``head_sha`` of its change.
    What a batch finds (processed issues, reviewed commits) is what the next one starts from. All tables become visible with one
    marker, so a batch that fails anywhere leaves no trace, and one that is run twice changes nothing.
    """
    tables = BatchTables(comments.sparkSession, root, batch_id, REDUCE, fan)
    if tables.done:
        return
    stored = ledger.store_comments(tables, comments, reviews.AT).withColumn("repo_id", F.col("repo_id").cast("string"))
    tables.save(stored.select(*EVENTS.names), "events")
    number = F.col("subject_number")
    asked = stored.where("route = 'blame'").select("repo_id", number.alias("issue_id"), *reviews.AT, "labels")
    reviews.store_issues(tables, asked, rank)
    pulls = stored.where("route = 'code_review'")
    pulls = pulls.select("repo_id", number.alias("pull_request_id"), *reviews.AT, "head_sha", F.col("run_again").alias("forced"))
    reviews.store_reviews(tables, pulls)
    tables.commit(KEPT)


def comment_event_job(comments: DataFrame, root: str, rank: reviews.Ranker, fan: int = FAN) -> StreamingQuery:
    """Run the job over all comments available now; ``comments`` is a stream of projected events of either host."""
    return ledger.in_batches(comments, root, lambda df, batch_id: store_batch(df, batch_id, root, rank, fan))


def outcomes(spark: SparkSession, root: str) -> DataFrame:
    """What became of every comment: event_id, log_id, username, route, outcome and the commit a review starts from."""
    tables = BatchTables(spark, root)
    logs = tables.read("usage_logs", USAGE_LOGS).select(F.col("id").alias("log_id"), "comment_url")
    due = tables.read("due", reviews.DUE).select("event_id", F.lit("review").alias("due"), "since_sha")
    verdicts = tables.read("verdicts", reviews.VERDICTS).select("event_id", "verdict")
    rows = tables.read("events", EVENTS).join(logs, "comment_url").join(verdicts, "event_id", "left").join(due, "event_id", "left")
    outcome = F.coalesce("verdict", "due", F.when(F.col("route") == "code_review", "skip").otherwise("unknown"))
    return rows.select("event_id", "log_id", "username", "route", outcome.alias("outcome"), "since_sha")
