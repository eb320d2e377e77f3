"""Users and usage logs kept from a stream of comment events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewright.operators.state import new_usage_logs, new_users
from tracewright.schemas import LONG, USAGE_LOGS, USERS, record
from tracewright.streaming.tables import FAN, BatchTables

COUNTERS = record(last_user=LONG, last_log=LONG)
REDUCE = {"counters": lambda rows: rows.agg(F.max("last_user").alias("last_user"), F.max("last_log").alias("last_log"))}
KEPT = ("users", "usage_logs", "counters")


def store_comments(tables: BatchTables, comments: DataFrame, order: list[str]) -> DataFrame:
    """Users and logs of one batch of projected comments, which come back as a written table.

    Last ids sit in one tiny row per batch, so no history is scanned for them.
    """
    comments = tables.save(comments, "comments")
    last = tables.read("counters", COUNTERS).agg(F.max("last_user"), F.max("last_log")).first()
    last_user, last_log = last[0] or 0, last[1] or 0
    users = tables.read("users", USERS)
    now = F.col(order[0])
    fresh = tables.save(new_users(users, comments, order, last_user + 1, now), "users")
    logs = tables.save(new_usage_logs(users.unionByName(fresh), comments, order, last_log + 1, now), "usage_logs")
    ends = fresh.agg(F.coalesce(F.max("id"), F.lit(last_user)).alias("last_user")).withColumn("one", F.lit(1))
    log_ends = logs.agg(F.coalesce(F.max("id"), F.lit(last_log)).alias("last_log")).withColumn("one", F.lit(1))
    tables.save(ends.join(log_ends, "one").drop("one"), "counters")
    return comments


def append_comments(comments: DataFrame, batch_id: int, root: str, order: list[str], fan: int = FAN) -> None:
    """Store one batch of projected comments; a batch that is stored already changes nothing."""
    tables = BatchTables(comments.sparkSession, root, batch_id, REDUCE, fan)
    if not tables.done:
        store_comments(tables, comments, order)
        tables.commit(KEPT)


def comment_ledger(comments: DataFrame, root: str, order: list[str]) -> StreamingQuery:
    """Run the ledger over all comments available now.

    ``comments`` is a stream of projected events of either host; ``order`` starts with the event time and ends
    unique.
    """
    return in_batches(comments, root, lambda df, batch_id: append_comments(df, batch_id, root, order))


def in_batches(rows: DataFrame, root: str, store) -> StreamingQuery:
    """Hand all rows available now to ``store``, batch by batch; progress is kept under ``root``."""
    writer = rows.writeStream.foreachBatch(store).option("checkpointLocation", f"{root}/_progress")
    return writer.trigger(availableNow=True).start()


def ledger_tables(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Users and usage logs as committed."""
    tables = BatchTables(spark, root)
    return tables.read("users", USERS), tables.read("usage_logs", USAGE_LOGS)
