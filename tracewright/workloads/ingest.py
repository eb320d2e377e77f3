"""Taking in staged changes and reading their bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import text
from tracewright.operators import commits as ahead
from tracewright.operators import state
from tracewright.plans import ingest as plan
from tracewright.workloads import feeds
from tracewright.workloads.base import ctes, query, t
from tracewright.workloads.feeds import BODIES, COMMITS

def _ingest(spark: SparkSession, d: str) -> plan.Ingest:
    """Labelled documents are stored already, and linked to an issue by their quality."""
    repo = F.lit(feeds.REPO).alias("repo_id")
    labels = t(spark, d, "labels")
    links = labels.select(
        (F.col("quality") + 1995).cast("bigint").alias("issue_id"), F.col("doc_id").alias("pull_request_id"), repo
    )
    return plan.ingest_staged(
        feeds.commits(spark, d),
        feeds.bodies(spark, d),
        labels.select(repo, F.col("doc_id").alias("id")),
        links,
        "src1",
        F.lit("2025-01-01 00:00:00").cast("timestamp"),
    )


STAGED = r"""staged AS (
  SELECT DISTINCT regexp_extract(message, '^Merge pull request #(\d+)', 1)::BIGINT AS pull_request_id
  FROM commits c
  WHERE branch = 'staging' AND regexp_matches(message, '^Merge pull request #\d+')
    AND NOT EXISTS (SELECT 1 FROM commits b WHERE b.branch = 'production' AND b.sha = c.sha))"""


@query(ctes(COMMITS, STAGED) + "SELECT pull_request_id FROM staged")
def staged_not_released(spark: SparkSession, d: str) -> DataFrame:
    return ahead.merged_numbers(ahead.commits_ahead(feeds.commits(spark, d))).select("pull_request_id")


@query(
    ctes(COMMITS)
    + r"""SELECT DISTINCT regexp_extract(message, '^Merge pull request #(\d+)', 1)::BIGINT AS pull_request_id
FROM commits WHERE regexp_matches(message, '^Merge pull request #\d+')"""
)
def merge_pr_numbers(spark: SparkSession, d: str) -> DataFrame:
    return ahead.merged_numbers(feeds.commits(spark, d)).select("pull_request_id")


@query(
    """SELECT doc_id AS pull_request_id FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"""
)
def new_pr_ids(spark: SparkSession, d: str) -> DataFrame:
    repo = F.lit(feeds.REPO).alias("repo_id")
    candidates = t(spark, d, "documents").select(repo, F.col("doc_id").alias("pull_request_id"))
    stored = t(spark, d, "labels").select(repo, F.col("doc_id").alias("id"))
    return ahead.unseen(candidates, stored).select("pull_request_id")


@query(
    """SELECT DISTINCT l_suppkey AS issue_id, l_partkey AS pull_request_id, 0::DOUBLE AS score FROM lineitem l
WHERE l_partkey IN (SELECT vec_id FROM embeddings) AND NOT EXISTS (
  SELECT 1 FROM lineitem r WHERE r.l_returnflag = 'R' AND r.l_suppkey = l.l_suppkey AND r.l_partkey = l.l_partkey)"""
)
def linked_existing(spark: SparkSession, d: str) -> DataFrame:
    """Links to add: to embedded parts, unless returned items have stored them already."""
    rows = t(spark, d, "lineitem").select(
        F.lit(feeds.REPO).alias("repo_id"),
        F.col("l_suppkey").alias("issue_id"),
        F.col("l_partkey").alias("pull_request_id"),
        "l_returnflag",
    )
    stored = rows.filter(F.col("l_returnflag") == "R").distinct()
    pulls = t(spark, d, "embeddings").select(F.lit(feeds.REPO).alias("repo_id"), F.col("vec_id").alias("id"))
    return state.new_links(stored, rows, pulls).select("issue_id", "pull_request_id", "score")


TIDY = r"trim(regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), e' \t\n\r')"
TESTS_SQL = TIDY.format(
    x=r"regexp_replace(regexp_replace(trim(regexp_extract(body, '(?is)(### Tests.*?)### PR Author Checklist', 1), e' \t\n\r'),"
    r" '\r\n?', chr(10), 'g'), '- \[[ xX]\]\s*', '', 'g')"
)
EXPLAINED_SQL = TIDY.format(
    x=r"trim(regexp_extract(body, '(?is)### Explanation of Change(.*?)### Fixed Issues', 1), e' \t\n\r')"
)
LINKED_SQL = r"""list_transform(regexp_extract_all(body,
    '\$\s*(?:#[0-9]+|https://[^\s]*/src1/issues/[0-9]+|\[#[0-9]+\]\(https://[^\s]*/src1/issues/[0-9]+\))'),
    lambda m: CASE WHEN regexp_matches(m, '^\$\s*\[#') THEN regexp_extract(m, '\[#([0-9]+)\]', 1)
      ELSE regexp_extract(m, '([0-9]+)$', 1) END)"""


@query(ctes(BODIES) + f"SELECT doc_id AS id, {TESTS_SQL} AS test, {EXPLAINED_SQL} AS explanation FROM bodies")
def pr_body_sections(spark: SparkSession, d: str) -> DataFrame:
    body = F.col("body")
    return feeds.bodies(spark, d).select(
        "id", text.test_steps(body).alias("test"), text.explanation(body).alias("explanation")
    )


@query(
    r"""WITH bodies AS (SELECT doc_id AS id, source, text || chr(10) || '## Action performed:' || chr(10) || '1. ' || source
  || chr(10) || text || chr(10) || '## Expected Result:' || chr(10) || 'ok' || chr(10) || '## Actual Result:' || chr(10)
  || 'bad ' || lang || chr(10) || chr(10) || '## Workaround:' || chr(10) || 'none' AS body FROM documents),
steps AS (SELECT *, trim(regexp_extract(body, '(?is)(##\s*Action\s*Performed:\s*.*?##\s*Expected\s*Result:\s*.*?'
  || '##\s*Actual\s*Result:\s*.*?)##\s*Workaround:', 1), e' \t\n\r') AS steps FROM bodies)
SELECT id, steps, source || '?' || chr(10) || ' ' || steps AS embedding_text FROM steps"""
)
def issue_steps(spark: SparkSession, d: str) -> DataFrame:
    rows = feeds.issue_bodies(spark, d).withColumn("steps", text.reproduction_steps(F.col("body")))
    embedding = text.issue_embedding_text(F.col("title"), F.col("steps"))
    return rows.select("id", "steps", embedding.alias("embedding_text"))


@query(
    ctes(BODIES) + f"SELECT doc_id AS id, array_to_string({LINKED_SQL}, ',') AS linked FROM bodies"
)
def linked_issue_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = text.linked_issue_ids(F.col("body"), "src1")
    return feeds.bodies(spark, d).select("id", F.array_join(ids.cast("array<string>"), ",").alias("linked"))


@query(
    ctes(
        COMMITS,
        STAGED,
        BODIES,
        f"read AS (SELECT *, {TESTS_SQL} AS test, {EXPLAINED_SQL} AS explained FROM bodies)",
    )
    + r"""SELECT doc_id AS id, 'Title: ' || title || chr(10) || ' Tests: ' || test || chr(10) || ' Explanation: ' || explained
  || chr(10) || ' Files changed: [''src/' || source || ''', "it''s/' || lang || '"]' || chr(10)
  || ' Code diff summary: has ' || n_chars AS embedding_text
FROM read WHERE doc_id IN (SELECT pull_request_id FROM staged) AND doc_id NOT IN (SELECT doc_id FROM labels)"""
)
def staged_pr_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The whole job: staged numbers, those not stored yet, their fields and text to embed."""
    return _ingest(spark, d).fresh.select("id", "embedding_text")


@query(
    ctes(COMMITS)
    + r"""SELECT DISTINCT issue_id::BIGINT AS issue_id, regexp_extract(message, '^Merge pull request #(\d+)', 1)::BIGINT AS pull_request_id
FROM commits c
WHERE branch = 'staging' AND regexp_matches(message, '^Merge pull request #\d+')
  AND NOT EXISTS (SELECT 1 FROM commits b WHERE b.branch = 'production' AND b.sha = c.sha)
  AND regexp_extract(message, '^Merge pull request #(\d+)', 1)::BIGINT IN (SELECT doc_id FROM documents)
  AND NOT EXISTS (SELECT 1 FROM labels l WHERE 1995 + l.quality = c.issue_id
    AND l.doc_id = regexp_extract(c.message, '^Merge pull request #(\d+)', 1)::BIGINT)"""
)
def staged_links(spark: SparkSession, d: str) -> DataFrame:
    """Links the same job adds: from each asking issue to what its request found."""
    return _ingest(spark, d).links.select("issue_id", "pull_request_id")
