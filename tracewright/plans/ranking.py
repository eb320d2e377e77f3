"""From bug reports to ranked candidates, and back from chosen culprits to stored results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import culprit_comment
from tracewright.operators.gates import issue_gate
from tracewright.operators.similarity import candidate_blocks, score_links, top_page, without_cherry_picks
from tracewright.operators.state import mark_processed, set_scores


@dataclass
class Ranking:
    verdicts: DataFrame
    scores: DataFrame
    ranked: DataFrame
    blocks: DataFrame


def rank_candidates(
    requests: DataFrame,
    issues: DataFrame,
    issue_embeddings: DataFrame,
    pull_requests: DataFrame,
    pull_request_embeddings: DataFrame,
    links: DataFrame,
    page: int = 0,
) -> Ranking:
    """Candidates of every admitted issue: gate, filter, score, one page of the best, text blocks."""
    verdicts = issue_gate(requests, issues)
    admitted = verdicts.filter(F.col("verdict") == "admitted").select("repo_id", "issue_id")
    eligible = without_cherry_picks(pull_requests)
    kept = eligible.select("repo_id", F.col("id").alias("pull_request_id"))
    candidates = links.join(admitted, ["repo_id", "issue_id"], "left_semi").join(
        kept, ["repo_id", "pull_request_id"], "left_semi"
    )
    scores = score_links(candidates, issue_embeddings, pull_request_embeddings)
    ranked = top_page(scores, page)
    return Ranking(verdicts, scores, ranked, candidate_blocks(ranked, eligible))


def store_scores(links: DataFrame, ranking: Ranking) -> DataFrame:
    return set_scores(links, ranking.scores)


def join_pages(answers: DataFrame) -> DataFrame:
    """One answer per issue from accepted answers to several pages, in page order; empty ones add nothing.

    ``answers`` has repo_id, page, answer and accepted. An answer names a few culprits, so the lists stay short.
    """
    issue = F.col("answer.issue_id").alias("issue_id")
    entry = F.struct("page", F.col("answer.pull_requests").alias("found"))
    listed = answers.filter("accepted").groupBy("repo_id", issue).agg(F.sort_array(F.collect_list(entry)).alias("pages"))
    found = F.flatten(F.transform("pages", lambda p: p["found"])).alias("pull_requests")
    return listed.select("repo_id", F.struct("issue_id", found).alias("answer"), F.lit(True).alias("accepted"))


def publish_culprits(answers: DataFrame) -> DataFrame:
    """Comments for accepted answers ``repo_id, answer``; issues without culprits get none."""
    found = answers.filter(F.col("accepted") & (F.size("answer.pull_requests") > 0))
    return found.select(
        "repo_id",
        F.col("answer.issue_id").alias("issue_id"),
        culprit_comment(F.col("answer.pull_requests")).alias("comment"),
    )


def store_culprits(issues: DataFrame, answers: DataFrame) -> DataFrame:
    """Mark issues with culprits as processed."""
    done = answers.filter(F.col("accepted") & (F.size("answer.pull_requests") > 0)).select(
        "repo_id",
        F.col("answer.issue_id").alias("id"),
        F.lit(True).alias("is_processed"),
        F.col("answer.pull_requests").alias("culprit_pull_requests"),
    )
    return mark_processed(issues, done)
