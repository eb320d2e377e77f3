"""Keyed tables as snapshots: each write is a function from the current rows and the changes to the next rows."""

from __future__ import annotations

from collections.abc import Sequence
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.operators.ledger import price_calls
from tracewright.operators.ordering import sequence_rows
from tracewright.schemas import ISSUES, MODEL_CALLS, PULL_REQUESTS, USAGE_LOGS, USERS

PULL = ["repo_id", "pull_request_id"]
ISSUE = ["repo_id", "issue_id"]


def shaped(df: DataFrame, schema: T.StructType, **defaults: Column) -> DataFrame:
    """The columns of ``schema``; those the frame lacks take their default, or null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def one_per_key(rows: DataFrame, keys: Sequence[str], version: Sequence[str] = ()) -> DataFrame:
    """One row per key: the one with the greatest ``version`` (columns of ``rows``).

    Without a version, or among equal ones, the choice is fixed by the values, not by the order of rows.
    """
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.dropDuplicates(list(keys))
    newest = F.struct(*version, F.xxhash64(*rest))
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), newest).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in rows.columns])


def replace_rows(current: DataFrame, rows: DataFrame, keys: Sequence[str], version: Sequence[str] = ()) -> DataFrame:
    """Rows win over current ones with the same key, as a whole: nothing of the old row survives.

    Of several rows with one key the last ``version`` counts.
    """
    rows = one_per_key(rows, keys, version)
    return current.join(rows.select(*keys), list(keys), "left_anti").select(*rows.columns).unionByName(rows)


def update_columns(
    current: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str], version: Sequence[str] = ()
) -> DataFrame:
    """Set columns of existing rows, also to null; changes to missing keys have no effect.

    Of several changes with one key the last ``version`` counts.
    """
    changes = one_per_key(changes.select(*dict.fromkeys([*keys, *columns, *version])), keys, version)
    incoming = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = current.join(incoming, list(keys), "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
            for c in current.columns
        ]
    )


def upsert_pull_requests(
    pulls: DataFrame, embeddings: DataFrame, links: DataFrame, rows: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replace changes together with their embedding.

    Replacing drops the old row with everything that hangs on it: its links go, its embedding is the new one,
    and columns the new row does not give return to their defaults.
    """
    rows = one_per_key(rows, ["repo_id", "id"])
    new = shaped(rows, PULL_REQUESTS, created_at=now)
    keys = rows.select("repo_id", F.col("id").alias("pull_request_id"))
    vectors = rows.select(
        F.col("id").alias("pull_request_id"), "repo_id", "embedding", now.cast("timestamp").alias("created_at")
    )
    return (
        replace_rows(pulls, new, ["repo_id", "id"]),
        replace_rows(embeddings, vectors, PULL),
        links.join(keys, PULL, "left_anti").select(*links.columns),
    )


def upsert_issues(
    issues: DataFrame, embeddings: DataFrame, links: DataFrame, rows: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replace issues and their embedding; a replaced issue is unprocessed again and has no links."""
    rows = one_per_key(rows, ["repo_id", "id"])
    new = shaped(rows.drop("is_processed"), ISSUES, is_processed=F.lit(False), created_at=now)
    keys = rows.select("repo_id", F.col("id").alias("issue_id"))
    vectors = rows.select(
        F.col("id").alias("issue_id"), "repo_id", "embedding", now.cast("timestamp").alias("created_at")
    )
    return (
        replace_rows(issues, new, ["repo_id", "id"]),
        replace_rows(embeddings, vectors, ISSUE),
        links.join(keys, ISSUE, "left_anti").select(*links.columns),
    )


def new_links(links: DataFrame, wanted: DataFrame, pulls: DataFrame) -> DataFrame:
    """Links not stored yet, to changes that exist, with score 0."""
    known = pulls.select("repo_id", F.col("id").alias("pull_request_id"))
    key = ["issue_id", "pull_request_id", "repo_id"]
    return (
        wanted.select(*key)
        .distinct()
        .join(known, PULL, "left_semi")
        .join(links.select(*key), key, "left_anti")
        .select(*key, F.lit(0.0).alias("score"))
    )


def mark_processed(issues: DataFrame, results: DataFrame) -> DataFrame:
    """Store the flag and the culprits of finished issues."""
    return update_columns(issues, results, ["repo_id", "id"], ["is_processed", "culprit_pull_requests"])


def set_ground_truth(issues: DataFrame, truth: DataFrame) -> DataFrame:
    return update_columns(issues, truth, ["repo_id", "id"], ["actual_pull_request_id"])


def set_scores(links: DataFrame, scores: DataFrame) -> DataFrame:
    return update_columns(links, scores, ["repo_id", "issue_id", "pull_request_id"], ["score"])


def new_users(users: DataFrame, seen: DataFrame, order: Sequence[str], start: int, now: Column) -> DataFrame:
    """Rows for usernames not stored yet: the first appearance counts, ids follow the order of appearance.

    The last column of ``order`` must be unique.
    """
    at = F.struct(*order)
    first = seen.groupBy("username").agg(F.min(at).alias("_at"))
    firsts = first.join(users.select("username"), "username", "left_anti").select("username", "_at.*")
    rows = seen.join(firsts, ["username", *order], "left_semi")
    numbered = sequence_rows(rows, list(order), start, "id")
    return shaped(numbered.drop("created_at"), USERS, is_active=F.lit(True), created_at=now)


def new_usage_logs(users: DataFrame, comments: DataFrame, order: Sequence[str], start: int, now: Column) -> DataFrame:
    """Log rows of comments, with the id of their user, numbered in order."""
    who = users.select(F.col("id").alias("user_id"), "username")
    numbered = sequence_rows(comments.join(who, "username"), list(order), start, "id")
    return shaped(
        numbered.drop("created_at").withColumnRenamed("subject_url", "issue_or_pull_request_url"),
        USAGE_LOGS,
        output=F.lit("default output"),
        created_at=now,
    )


def new_model_calls(calls: DataFrame, order: Sequence[str], start: int, now: Column) -> DataFrame:
    """Ledger rows of model calls, priced and numbered in order; calls without a price are left out."""
    numbered = sequence_rows(price_calls(calls), list(order), start, "id")
    return shaped(numbered.drop("created_at"), MODEL_CALLS, created_at=now)


def record_reviews(reviews: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """Remember the commit each change was last reviewed at."""
    rows = done.select("pull_request_id", "repo_id", "last_reviewed_commit_sha", now.cast("timestamp").alias("updated_at"))
    return replace_rows(reviews, rows, PULL)


# How stored tables changed, in order: table, kind of step, column, and its type or new name.
MIGRATIONS = (
    ("usage_logs", "add", "comment_text", "string"),
    ("pull_requests", "add", "linked_issue_ids", "array<bigint>"),
    ("llm_calls", "rename", "cost_usd_cents", "cost_usd_thousandths"),
    ("pull_requests", "rename", "explaination", "explanation"),
    ("pull_request_test_steps", "drop", None, None),
    ("test_suite", "drop", None, None),
)


def migrate(tables: dict[str, DataFrame], since: int = 0) -> dict[str, DataFrame]:
    """Bring tables written before step ``since`` to the current columns."""
    now = dict(tables)
    for table, kind, column, target in MIGRATIONS[since:]:
        if table not in now:
            continue
        if kind == "drop":
            del now[table]
        elif kind == "rename":
            now[table] = now[table].withColumnRenamed(column, target)
        elif column not in now[table].columns:
            now[table] = now[table].withColumn(column, F.lit(None).cast(target))
    return now


def drop_orphans(child: DataFrame, parent: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows whose parent exists; ``on`` maps child columns to parent columns."""
    keys = parent.select(*[F.col(p).alias(c) for c, p in on.items()]).distinct()
    return child.join(keys, list(on), "left_semi").select(*child.columns)


def clear_missing(child: DataFrame, parent: DataFrame, column: str, on: dict[str, str]) -> DataFrame:
    """Null the reference of rows whose parent is gone."""
    keys = parent.select(*[F.col(p).alias(c) for c, p in on.items()]).distinct().withColumn("_there", F.lit(True))
    joined = child.join(keys, list(on), "left")
    return joined.select(
        *[F.when(F.col("_there"), F.col(c)).alias(c) if c == column else F.col(c) for c in child.columns]
    )


# Which columns of a table point at which table; a column to clear when its parent is gone, else the row goes.
FOREIGN_KEYS = (
    ("issues", {"repo_id": "repo_id", "actual_pull_request_id": "id"}, "pull_requests", "actual_pull_request_id"),
    ("pull_request_embeddings", {"repo_id": "repo_id", "pull_request_id": "id"}, "pull_requests", None),
    ("issue_embeddings", {"repo_id": "repo_id", "issue_id": "id"}, "issues", None),
    ("issue_pull_request", {"repo_id": "repo_id", "issue_id": "id"}, "issues", None),
    ("issue_pull_request", {"repo_id": "repo_id", "pull_request_id": "id"}, "pull_requests", None),
    ("usage_logs", {"user_id": "id"}, "users", None),
    ("llm_calls", {"usage_log_id": "id"}, "usage_logs", None),
)


def with_integrity(tables: dict[str, DataFrame], foreign_keys: Sequence[tuple] = FOREIGN_KEYS) -> dict[str, DataFrame]:
    """All tables without orphans: one plan along the foreign keys, each table after all tables it points at."""
    parents: dict[str, set[str]] = {name: set() for name in tables}
    for child, _, parent, _ in foreign_keys:
        if child in tables and parent in tables and child != parent:
            parents[child].add(parent)
    now = dict(tables)
    for name in TopologicalSorter(parents).static_order():
        for child, on, parent, clear in foreign_keys:
            if child == name and parent in now:
                now[name] = clear_missing(now[name], now[parent], clear, on) if clear else drop_orphans(now[name], now[parent], on)
    return {name: now[name] for name in tables}


def delete_cascade(tables: dict[str, DataFrame], name: str, gone: DataFrame) -> dict[str, DataFrame]:
    """The tables after rows of one of them were deleted (``gone`` has their key columns) with all that hangs on them."""
    left = tables[name].join(gone.distinct(), gone.columns, "left_anti").select(*tables[name].columns)
    return with_integrity({**tables, name: left})
