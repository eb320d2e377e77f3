"""Ranking changes for issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.text import CULPRIT_TITLE
from tracewright.operators import gates, responses, similarity, state
from tracewright.plans import ranking as plan
from tracewright.workloads import feeds
from tracewright.workloads.base import ctes, query
from tracewright.workloads.feeds import LINKS, PULLS, SCORES, VECTORS


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return similarity.score_links(
        feeds.links(spark, d), feeds.vectors(spark, d, "issue_id"), feeds.vectors(spark, d, "pull_request_id")
    )


def _page_sql(page: int) -> str:
    return (
        ctes(
            LINKS,
            VECTORS,
            SCORES,
            """ranked AS (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY score DESC, pull_request_id)
  AS rank FROM scores)""",
        )
        + "SELECT issue_id, pull_request_id, round(score, 6) AS score, rank::INTEGER AS rank FROM ranked "
        + f"WHERE rank BETWEEN {25 * page + 1} AND {25 * page + 25}"
    )


def _page(spark: SparkSession, d: str, page: int) -> DataFrame:
    ranked = similarity.top_page(_scores(spark, d), page)
    return ranked.select("issue_id", "pull_request_id", F.round("score", 6).alias("score"), "rank")


@query(_page_sql(0))
def culprit_topk(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, 0)


@query(_page_sql(1))
def culprit_topk_second_page(spark: SparkSession, d: str) -> DataFrame:
    return _page(spark, d, 1)


@query(
    ctes(LINKS, VECTORS, SCORES)
    + """SELECT l.issue_id, l.pull_request_id, round(coalesce(s.score, 0), 6) AS score
FROM links l LEFT JOIN scores s USING (issue_id, pull_request_id)"""
)
def link_scores(spark: SparkSession, d: str) -> DataFrame:
    """The link table with the scores set."""
    links = feeds.links(spark, d).withColumn("score", F.lit(0.0))
    stored = state.set_scores(links, _scores(spark, d))
    return stored.select("issue_id", "pull_request_id", F.round("score", 6).alias("score"))


@query(
    ctes(PULLS)
    + """SELECT p.id, p.title, e.vec_id IS NOT NULL AS embedded, len(e.embedding)::INTEGER AS dimensions
FROM pulls p LEFT JOIN embeddings e ON e.vec_id = p.id"""
)
def pr_with_embedding(spark: SparkSession, d: str) -> DataFrame:
    vectors = feeds.vectors(spark, d, "pull_request_id")
    rows = similarity.with_embedding(feeds.pull_requests(spark, d), vectors)
    return rows.select(
        "id", "title", F.col("embedding").isNotNull().alias("embedded"), F.size("embedding").alias("dimensions")
    )


@query(
    ctes(LINKS, PULLS)
    + """SELECT l.issue_id, p.id AS pull_request_id, p.title, e.vec_id IS NOT NULL AS embedded
FROM links l JOIN pulls p ON p.id = l.pull_request_id LEFT JOIN embeddings e ON e.vec_id = p.id
WHERE NOT contains(lower(p.title), 'cp staging')"""
)
def issue_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = similarity.issue_candidates(
        feeds.links(spark, d), feeds.pull_requests(spark, d), feeds.vectors(spark, d, "pull_request_id")
    )
    kept = similarity.without_cherry_picks(rows)
    return kept.select("issue_id", "pull_request_id", "title", F.col("embedding").isNotNull().alias("embedded"))


VERDICTS = """verdicts AS (
  SELECT s_suppkey AS issue_id, CASE WHEN s_nationkey = 3 THEN 'already processed'
    WHEN NOT s_acctbal > 0 THEN 'not labeled' ELSE 'admitted' END AS verdict
  FROM supplier)"""


@query(ctes(VERDICTS) + "SELECT * FROM verdicts")
def issue_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = gates.issue_gate(feeds.issue_requests(spark, d), feeds.issues(spark, d))
    return rows.select("issue_id", "verdict")


def _ranking(spark: SparkSession, d: str) -> plan.Ranking:
    return plan.rank_candidates(
        feeds.issue_requests(spark, d),
        feeds.issues(spark, d),
        feeds.vectors(spark, d, "issue_id"),
        feeds.pull_requests(spark, d),
        feeds.vectors(spark, d, "pull_request_id"),
        feeds.links(spark, d),
    )


RANKED = """ranked AS (
  SELECT s.issue_id, s.score, p.*,
    row_number() OVER (PARTITION BY s.issue_id ORDER BY s.score DESC, s.pull_request_id) AS rank
  FROM scores s JOIN pulls p ON p.id = s.pull_request_id JOIN verdicts v ON v.issue_id = s.issue_id
  WHERE v.verdict = 'admitted' AND NOT contains(lower(p.title), 'cp staging')),
top25 AS (SELECT * FROM ranked WHERE rank <= 25)"""


@query(
    ctes(LINKS, VECTORS, SCORES, PULLS, VERDICTS, RANKED)
    + """SELECT issue_id, count(*)::INTEGER AS candidates, string_agg(
  'PR id #' || id || repeat(chr(10), 2) || 'Title: ' || title || repeat(chr(10), 2)
  || 'Test Steps: ' || coalesce(trim(test), 'No test steps provided.') || repeat(chr(10), 2)
  || 'Files Changed: ' || CASE WHEN len(files) = 0 THEN 'No files listed.' ELSE array_to_string(files, ', ') END
  || repeat(chr(10), 2)
  || 'Code diff summary: ' || coalesce(code_diff_summary, 'No code diff summary provided.') || repeat(chr(10), 2)
  || 'Score: ' || format('{:.2f}', score) || repeat(chr(10), 2)
  || 'Explanation: ' || CASE WHEN explanation = '' THEN 'No explanation provided.' ELSE explanation END,
  repeat(chr(10), 2) ORDER BY rank) AS block
FROM top25 GROUP BY issue_id"""
)
def candidate_cards(spark: SparkSession, d: str) -> DataFrame:
    """The whole job: gate, filter, score, best 25, one text block per issue."""
    return _ranking(spark, d).blocks.select("issue_id", "candidates", "block")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Three culprits of each of two pages per issue, as JSON text the way a model answers."""
    scores = _scores(spark, d)  # ranked once; the pages are cut from that
    best = similarity.top_page(scores, 0, 6).withColumn("page", F.expr("(rank - 1) div 3").cast("int"))
    entry = F.struct("rank", "pull_request_id", F.concat(F.lit("score rank "), "rank").alias("reason"))
    listed = best.groupBy("repo_id", "issue_id", "page").agg(F.sort_array(F.collect_list(entry)).alias("l"))
    culprits = F.transform("l", lambda c: F.struct(c["pull_request_id"], c["reason"]))
    body = F.to_json(F.struct("issue_id", culprits.alias("pull_requests")))
    texts = listed.select("repo_id", "page", body.alias("response"))
    return plan.join_pages(responses.parse_answers(texts, "culprits"))


TOP6 = """ranked AS (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY score DESC, pull_request_id) AS rank
  FROM scores), top6 AS (SELECT * FROM ranked WHERE rank <= 6)"""


@query(
    ctes(LINKS, VECTORS, SCORES, TOP6)
    + f"""SELECT issue_id, '### {CULPRIT_TITLE}' || chr(10) || string_agg(
  (CASE WHEN rank = 3 THEN chr(10) || '#### If not above, check these' || chr(10) ELSE '' END)
  || '- #' || pull_request_id || ': score rank ' || rank || chr(10), '' ORDER BY rank) AS comment
FROM top6 GROUP BY issue_id"""
)
def culprit_comment(spark: SparkSession, d: str) -> DataFrame:
    answers = _answers(spark, d)
    return plan.publish_culprits(answers).select("issue_id", "comment")


@query(
    ctes(LINKS, VECTORS, SCORES, TOP6)
    + """SELECT s.s_suppkey AS issue_id, t.issue_id IS NOT NULL OR s_nationkey = 3 AS is_processed,
  (t.rank - 1)::INTEGER AS place, t.pull_request_id, 'score rank ' || t.rank AS reason
FROM supplier s LEFT JOIN top6 t ON t.issue_id = s.s_suppkey"""
)
def culprit_rows(spark: SparkSession, d: str) -> DataFrame:
    """Issues with the answers stored, one row per culprit."""
    none = F.lit(None).cast("array<struct<pull_request_id: bigint, reason: string>>")
    issues = feeds.issues(spark, d).withColumn("culprit_pull_requests", none)
    answers = _answers(spark, d)
    rows = responses.culprit_rows(plan.store_culprits(issues, answers))
    return rows.select(F.col("id").alias("issue_id"), "is_processed", "place", "pull_request_id", "reason")
