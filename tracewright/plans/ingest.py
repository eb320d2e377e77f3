"""Taking in the changes that wait for release."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import explanation, linked_issue_ids, pull_request_embedding_text, test_steps
from tracewright.operators.commits import commits_ahead, merged_by, unseen
from tracewright.operators.state import new_links


@dataclass
class Ingest:
    staged: DataFrame
    fresh: DataFrame
    links: DataFrame


def describe_pull_requests(bodies: DataFrame, repo_name: str) -> DataFrame:
    """Add the fields read from the body, and the text to embed.

    ``bodies`` has title, body, files and code_diff_summary.
    """
    body = F.coalesce("body", F.lit(""))
    read = bodies.withColumns(
        {
            "test": test_steps(body),
            "explanation": explanation(body),
            "linked_issue_ids": linked_issue_ids(body, repo_name),
        }
    )
    text = pull_request_embedding_text(
        F.col("title"), F.col("test"), F.col("explanation"), F.col("files"), F.col("code_diff_summary")
    )
    return read.withColumn("embedding_text", text).drop("body")


def ingest_staged(
    commits: DataFrame, bodies: DataFrame, pull_requests: DataFrame, links: DataFrame, repo_name: str, now: Column
) -> Ingest:
    """Staged changes, those of them to store, and links from the asking issues.

    ``commits`` has repo_id, branch, sha, message and the ``issue_id`` whose request listed the commit. An issue is
    linked to what its own request found, stored before or not, so no issues and changes are ever paired up.
    """
    ahead = commits_ahead(commits)
    found = merged_by(ahead, "issue_id")
    staged = found.select("repo_id", "pull_request_id").distinct()
    wanted = unseen(staged, pull_requests).withColumnRenamed("pull_request_id", "id")
    fresh = describe_pull_requests(bodies.join(wanted, ["repo_id", "id"], "left_semi"), repo_name).withColumn(
        "created_at", now
    )
    stored = pull_requests.select("repo_id", "id").unionByName(fresh.select("repo_id", "id"))
    return Ingest(staged, fresh, new_links(links, found.filter(F.col("issue_id").isNotNull()), stored))
