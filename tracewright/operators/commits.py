"""Changes that are on one branch and not yet on another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import merged_pull_request


def commits_ahead(commits: DataFrame, base: str = "production", head: str = "staging") -> DataFrame:
    """Commits of ``head`` that ``base`` lacks, per repository."""
    on = lambda branch: commits.filter(F.col("branch") == branch)
    released = on(base).select("repo_id", "sha").distinct()
    return on(head).join(released, ["repo_id", "sha"], "left_anti")


def merged_by(commits: DataFrame, *keys: str) -> DataFrame:
    """Distinct numbers of the changes merged by the commits, per repository and further keys."""
    numbered = commits.select("repo_id", *keys, merged_pull_request(F.col("message")).alias("pull_request_id"))
    return numbered.filter(F.col("pull_request_id").isNotNull()).distinct()


def merged_numbers(commits: DataFrame) -> DataFrame:
    return merged_by(commits)


def unseen(candidates: DataFrame, pulls: DataFrame) -> DataFrame:
    """Candidate numbers without a stored change."""
    known = pulls.select("repo_id", F.col("id").alias("pull_request_id"))
    return candidates.join(known, ["repo_id", "pull_request_id"], "left_anti")
