"""Findings, comments and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.text import COMMON_WORDS, CONCERNS, review_body
from tracewright.operators import gates, review
from tracewright.operators.ordering import ordered_chunks
from tracewright.plans import reviewing as plan
from tracewright.schemas import SIGNATURE
from tracewright.workloads import feeds
from tracewright.workloads.base import ctes, query, t
from tracewright.workloads.feeds import CHANGED, COMMENTS, FILES, FINDINGS

ID = "pull_request_id"
SIGNED = "'" + SIGNATURE.replace("\n", "' || chr(10) || '") + "'"


@query(ctes(FINDINGS) + "SELECT *, 'bandit' AS tool FROM findings WHERE severity <> 'low' AND ends_with(file_path, '.py')")
def finding_filter(spark: SparkSession, d: str) -> DataFrame:
    raw = review.python_files(feeds.raw_findings(spark, d))
    return review.at_least_medium(review.normalise_findings(raw)).drop("repo_id")


SECURITY = """security AS (
  SELECT f.pull_request_id, f.file_path AS file, f.line, f.start_line,
    upper(severity) || ': ' || description || ' (Rule: bandit ' || rule_id || ')' AS content, 'security' AS label
  FROM findings f WHERE severity <> 'low' AND ends_with(file_path, '.py') AND EXISTS (
    SELECT 1 FROM changed c WHERE c.pull_request_id = f.pull_request_id AND c.file = f.file_path AND c.line = f.line))"""


def _security(spark: SparkSession, d: str) -> DataFrame:
    findings = review.normalise_findings(review.python_files(feeds.raw_findings(spark, d)))
    return review.findings_to_comments(
        review.on_changed_lines(review.at_least_medium(findings), feeds.changed(spark, d))
    )


@query(ctes(FINDINGS, CHANGED, SECURITY) + "SELECT * FROM security")
def finding_comments(spark: SparkSession, d: str) -> DataFrame:
    return _security(spark, d).drop("repo_id")


def _words_sql(remark: str) -> str:
    """The words of a remark, in SQL."""
    plain = f"lower(regexp_replace(regexp_replace({remark}, '^[A-Z]+: ', ''), ' \\(Rule: [^)]*\\)$', ''))"
    for name, wordings in CONCERNS.items():
        plain = f"regexp_replace({plain}, '\\b(?:{wordings})\\b', ' is_{name} ', 'g')"
    return f"list_distinct(list_filter(regexp_extract_all({plain}, '[a-z0-9_]{{3,}}'), lambda w: w NOT IN {COMMON_WORDS}))"


KEPT = f"""said AS (SELECT *, row_number() OVER () AS said_id, {_words_sql("content")} AS said_words FROM comments),
warned AS (SELECT DISTINCT pull_request_id, file, line, {_words_sql("content")} AS warned_words FROM security),
repeats AS (
  SELECT DISTINCT said_id FROM said c JOIN warned s ON s.pull_request_id = c.pull_request_id AND s.file = c.file AND abs(s.line - c.line) <= 3
  WHERE 2 * len(list_intersect(said_words, warned_words)) >= least(len(said_words), len(warned_words))
    AND least(len(said_words), len(warned_words)) > 0),
kept AS (SELECT * EXCLUDE (said_id, said_words) FROM said WHERE said_id NOT IN (SELECT said_id FROM repeats))"""


@query(ctes(FINDINGS, CHANGED, SECURITY, COMMENTS, KEPT) + "SELECT * FROM kept")
def dedupe_comments(spark: SparkSession, d: str) -> DataFrame:
    return review.drop_near_security(feeds.review_comments(spark, d), _security(spark, d)).select(
        ID, "file", "line", "start_line", "content", "label"
    )


@query(
    ctes(FINDINGS, CHANGED, SECURITY, COMMENTS, KEPT, FILES)
    + f""", merged AS (SELECT 0 AS source, * FROM security UNION ALL SELECT 1 AS source, * FROM kept)
SELECT source, pull_request_id, file AS path, '**' || label || '**: ' || content || {SIGNED} AS body, line, 'RIGHT' AS side,
  CASE WHEN start_line <> 0 AND start_line < line THEN start_line END AS start_line,
  CASE WHEN start_line <> 0 AND start_line < line THEN 'RIGHT' END AS start_side
FROM merged m WHERE label IN ('security', 'issue', 'suggestion')
  AND EXISTS (SELECT 1 FROM files f WHERE f.pull_request_id = m.pull_request_id AND f.file = m.file)"""
)
def review_rows(spark: SparkSession, d: str) -> DataFrame:
    """The whole job: findings on changed lines and kept comments, as rows to post."""
    overviews = t(spark, d, "supplier").select(
        F.concat(F.lit("r"), F.pmod(F.col("s_suppkey"), F.lit(5))).alias("repo_id"),
        F.col("s_suppkey").alias(ID),
        F.col("s_name").alias("code_overview"),
        F.lit("").alias("since_sha"),
    )
    job = plan.assemble_review(
        feeds.raw_findings(spark, d),
        feeds.changed(spark, d),
        feeds.review_comments(spark, d),
        feeds.review_files(spark, d),
        overviews,
    )
    return job.rows.drop("repo_id")


@query(
    f"""SELECT d.doc_id AS pull_request_id, CASE WHEN l.doc_id IS NULL THEN '' ELSE
  '**This review covers only the changes made since the last review (commit ' || left(sha256(d.text), 7)
  || '), not the entire PR.**' || chr(10) || 'Use `full review` to review entire PR' || chr(10) END || d.text || {SIGNED} AS body
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
)
def review_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Overviews with the notice where an earlier review exists."""
    seen = t(spark, d, "labels").select("doc_id", F.lit(True).alias("seen"))
    rows = t(spark, d, "documents").join(seen, "doc_id", "left")
    sha = F.when(F.col("seen"), F.sha2("text", 256))
    return rows.select(F.col("doc_id").alias(ID), review_body(F.col("text"), sha).alias("body"))


@query(
    """SELECT d.doc_id AS pull_request_id, sha256(d.text) = coalesce(sha256(l.last), '') AND d.source <> 'src3' AS skip,
  CASE WHEN d.source <> 'src3' THEN sha256(l.last) END AS since_sha
FROM documents d LEFT JOIN (
  SELECT l.doc_id, CASE WHEN quality = 1 THEN x.text ELSE 'older' END AS last
  FROM labels l JOIN documents x ON x.doc_id = l.doc_id) l ON l.doc_id = d.doc_id"""
)
def review_skip(spark: SparkSession, d: str) -> DataFrame:
    """Head commits are text hashes; stored reviews are at the head or at an older commit."""
    repo = F.lit(feeds.REPO).alias("repo_id")
    requests = t(spark, d, "documents").select(
        repo,
        F.col("doc_id").alias(ID),
        F.sha2("text", 256).alias("head_sha"),
        (F.col("source") == "src3").alias("run_again"),
        "text",
    )
    at = F.sha2(F.when(F.col("quality") == 1, F.col("text")).otherwise("older"), 256)
    reviewed = (
        t(spark, d, "labels")
        .join(t(spark, d, "documents").select("doc_id", "text"), "doc_id")
        .select(repo, F.col("doc_id").alias(ID), at.alias("last_reviewed_commit_sha"))
    )
    return gates.review_gate(requests.drop("text"), reviewed).select(ID, "skip", "since_sha")


@query(
    ctes(COMMENTS)
    + """, placed AS (
  SELECT *, row_number() OVER (PARTITION BY pull_request_id
    ORDER BY file, line, start_line NULLS FIRST, content, label) - 1 AS place FROM comments)
SELECT pull_request_id, (place // 200)::BIGINT AS chunk, '[' || string_agg('{"file":"' || file || '","line":' || line
  || ',"start_line":' || coalesce(start_line::VARCHAR, 'null') || ',"content":"' || content || '","label":"' || label || '"}',
  ',' ORDER BY place) || ']' AS comments
FROM placed GROUP BY ALL"""
)
def comment_lists(spark: SparkSession, d: str) -> DataFrame:
    """Comments of each change as compact JSON lists of at most 200."""
    item = F.struct(*review.COMMENT)
    lists = ordered_chunks(feeds.review_comments(spark, d), [ID], review.COMMENT, item, 200)
    return lists.select(ID, "chunk", review.comment_json(F.col("items")).alias("comments"))
