"""Writes to keyed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import state
from tracewright.operators.ordering import latest_by
from tracewright.schemas import ISSUES, PULL_REQUESTS
from tracewright.session import scratch_path
from tracewright.sources.keyed import KeyedTable
from tracewright.workloads import feeds
from tracewright.workloads.base import ctes, query, t
from tracewright.workloads.feeds import LINKS, PULLS


def _now() -> Column:
    return F.lit("2025-01-01 00:00:00").cast("timestamp")


def _replaced_pulls(spark: SparkSession, d: str) -> DataFrame:
    """New rows for the parts of one brand: title and embedding only."""
    rows = t(spark, d, "part").filter(F.col("p_brand") == "Brand#7")
    vectors = t(spark, d, "embeddings").select(F.col("vec_id").alias("p_partkey"), "embedding")
    return rows.join(vectors, "p_partkey", "left").select(
        F.col("p_partkey").alias("id"),
        F.lit(feeds.REPO).alias("repo_id"),
        F.concat(F.lit("New "), "p_type").alias("title"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


def _stored_pulls(spark: SparkSession, d: str) -> DataFrame:
    return state.shaped(feeds.pull_requests(spark, d), PULL_REQUESTS)


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return feeds.vectors(spark, d, "pull_request_id").select(
        "pull_request_id",
        "repo_id",
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.lit(None).cast("timestamp").alias("created_at"),
    )


def _scored_links(spark: SparkSession, d: str) -> DataFrame:
    return feeds.links(spark, d).withColumn("score", F.lit(0.5))


def _upserted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return state.upsert_pull_requests(
        _stored_pulls(spark, d), _embeddings(spark, d), _scored_links(spark, d), _replaced_pulls(spark, d), _now()
    )


@query(
    ctes(PULLS)
    + """SELECT id, CASE WHEN p_brand = 'Brand#7' THEN 'New ' || p_type ELSE title END AS title,
  CASE WHEN p_brand <> 'Brand#7' THEN code_diff_summary END AS code_diff_summary, p_brand = 'Brand#7' AS dated
FROM pulls JOIN part ON p_partkey = id"""
)
def upsert_pr(spark: SparkSession, d: str) -> DataFrame:
    pulls, _, _ = _upserted(spark, d)
    return pulls.select("id", "title", "code_diff_summary", F.col("created_at").isNotNull().alias("dated"))


@query(
    """SELECT coalesce(p.p_partkey, e.vec_id) AS pull_request_id, e.vec_id IS NOT NULL AS embedded
FROM (SELECT p_partkey FROM part WHERE p_brand = 'Brand#7') p FULL JOIN embeddings e ON e.vec_id = p.p_partkey"""
)
def upsert_pr_embeddings(spark: SparkSession, d: str) -> DataFrame:
    _, vectors, _ = _upserted(spark, d)
    return vectors.select("pull_request_id", F.col("embedding").isNotNull().alias("embedded"))


@query(
    ctes(LINKS)
    + """SELECT issue_id, pull_request_id FROM links
WHERE pull_request_id NOT IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#7')"""
)
def upsert_pr_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The links left after changes were replaced."""
    _, _, links = _upserted(spark, d)
    return links.select("issue_id", "pull_request_id")


def _upserted_issues(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replaced issues are unprocessed again; only processed ones and their neighbours are replaced here."""
    stored = state.shaped(feeds.issues(spark, d), ISSUES)
    vectors = feeds.vectors(spark, d, "issue_id").withColumn("created_at", F.lit(None).cast("timestamp"))
    rows = (
        t(spark, d, "supplier")
        .filter(F.col("s_nationkey").isin(3, 4))
        .select(
            F.col("s_suppkey").alias("id"),
            F.lit(feeds.REPO).alias("repo_id"),
            F.concat("s_name", F.lit(" again")).alias("title"),
            F.array(F.lit(1.0)).alias("embedding"),
        )
    )
    vectors = vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    vectors = vectors.select("issue_id", "repo_id", "embedding", "created_at")
    return state.upsert_issues(stored, vectors, _scored_links(spark, d), rows, _now())


@query(
    """SELECT s_suppkey AS id, s_name || CASE WHEN s_nationkey IN (3, 4) THEN ' again' ELSE '' END AS title, false AS is_processed
FROM supplier"""
)
def upsert_issue(spark: SparkSession, d: str) -> DataFrame:
    issues, _, _ = _upserted_issues(spark, d)
    return issues.select("id", "title", "is_processed")


REPLACED = "replaced AS (SELECT s_suppkey AS issue_id FROM supplier WHERE s_nationkey IN (3, 4))"


@query(
    ctes(REPLACED)
    + """SELECT issue_id, 1::BIGINT AS size, true AS dated FROM replaced
UNION ALL SELECT vec_id, len(embedding), false FROM embeddings WHERE vec_id NOT IN (SELECT issue_id FROM replaced)"""
)
def upsert_issue_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Vectors after issues were replaced: theirs are the new ones, the others stay."""
    _, vectors, _ = _upserted_issues(spark, d)
    return vectors.select("issue_id", F.size("embedding").cast("long").alias("size"), F.col("created_at").isNotNull().alias("dated"))


@query(ctes(LINKS, REPLACED) + "SELECT issue_id, pull_request_id FROM links WHERE issue_id NOT IN (SELECT issue_id FROM replaced)")
def upsert_issue_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The links left after issues were replaced."""
    _, _, links = _upserted_issues(spark, d)
    return links.select("issue_id", "pull_request_id")


@query(
    ctes(PULLS)
    + """SELECT id, CASE WHEN p_brand = 'Brand#7' THEN 'New ' || p_type ELSE title END AS title,
  CASE WHEN p_size > 48 THEN 'long' WHEN p_brand <> 'Brand#7' THEN code_diff_summary END AS code_diff_summary
FROM pulls JOIN part ON p_partkey = id WHERE p_retailprice >= 905 OR p_brand = 'Brand#7'"""
)
def keyed_pull_requests(spark: SparkSession, d: str) -> DataFrame:
    """Changes kept in hash buckets: all stored, some deleted, some replaced, some updated; each step is a version of its own."""
    table = KeyedTable(spark, scratch_path(spark, "keyed"), PULL_REQUESTS, ["repo_id", "id"], 16)
    stored = _stored_pulls(spark, d)
    table.replace(stored)
    cheap = t(spark, d, "part").where("p_retailprice < 905").select(F.lit(feeds.REPO).alias("repo_id"), F.col("p_partkey").alias("id"))
    table.delete(cheap)
    table.replace(state.shaped(_replaced_pulls(spark, d), PULL_REQUESTS, created_at=_now()))
    big = t(spark, d, "part").where("p_size > 48").select(F.lit(feeds.REPO).alias("repo_id"), F.col("p_partkey").alias("id"), F.lit("long").alias("code_diff_summary"))
    table.update(big, ["code_diff_summary"])
    return table.read().select("id", "title", "code_diff_summary")


@query(
    """SELECT s.s_suppkey AS id, p.pull_request_id AS actual_pull_request_id FROM supplier s LEFT JOIN (
  SELECT l_suppkey, max(l_partkey) AS pull_request_id FROM lineitem GROUP BY l_suppkey) p ON p.l_suppkey = s.s_suppkey"""
)
def ground_truth(spark: SparkSession, d: str) -> DataFrame:
    """Set the change known to be the cause, here the highest one linked."""
    truth = (
        feeds.links(spark, d)
        .groupBy("repo_id", F.col("issue_id").alias("id"))
        .agg(F.max("pull_request_id").alias("actual_pull_request_id"))
    )
    issues = state.set_ground_truth(state.shaped(feeds.issues(spark, d), ISSUES), truth)
    return issues.select("id", "actual_pull_request_id")


@query(
    """WITH seen AS (SELECT 'Customer#' || lpad(user_id::VARCHAR, 9, '0') AS username, ts, event_id FROM events
  UNION ALL SELECT 'guest' || user_id, ts, event_id FROM events WHERE event_type = 'signup'),
firsts AS (SELECT DISTINCT ON (username) * FROM seen ORDER BY username, ts, event_id)
SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY ts, event_id) AS id, username
FROM firsts WHERE username NOT IN (SELECT c_name FROM customer)"""
)
def user_get_or_create(spark: SparkSession, d: str) -> DataFrame:
    """Users to add for the people seen in events; customers are known already."""
    events = t(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    named = events.select(
        F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("username"), "ts", "event_id"
    )
    guests = events.filter(F.col("event_type") == "signup").select(
        F.concat(F.lit("guest"), "user_id").alias("username"), "ts", "event_id"
    )
    users = feeds.users(spark, d)
    last = users.agg(F.max("id")).first()[0]
    return state.new_users(users, named.unionByName(guests), ["ts", "event_id"], last + 1, _now()).select("id", "username")


@query(
    """SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id, o_custkey AS user_id,
  'https://tracker.test/c/' || o_orderkey AS comment_url, 'default output' AS output
FROM orders JOIN customer ON c_custkey = o_custkey"""
)
def usage_append(spark: SparkSession, d: str) -> DataFrame:
    comments = t(spark, d, "orders").select(
        F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("username"),
        F.lit("blame").alias("command_name"),
        F.concat(F.lit("https://tracker.test/c/"), "o_orderkey").alias("comment_url"),
        "o_orderdate",
        "o_orderkey",
    )
    rows = state.new_usage_logs(feeds.users(spark, d), comments, ["o_orderdate", "o_orderkey"], 1, _now())
    return rows.select("id", "user_id", "comment_url", "output")


@query(
    """WITH done AS (SELECT user_id, max_by(json_extract_string(props, '$.k'), event_id) AS sha FROM events GROUP BY user_id)
SELECT coalesce(d.user_id, l.doc_id) AS pull_request_id, coalesce('c' || d.sha, 'old' || l.quality) AS last_reviewed_commit_sha
FROM labels l FULL JOIN done d ON d.user_id = l.doc_id"""
)
def review_watermark(spark: SparkSession, d: str) -> DataFrame:
    """The last reviewed commits after the events: the newest of each change wins over what is stored."""
    repo = F.lit(feeds.REPO).alias("repo_id")
    stored = t(spark, d, "labels").select(
        F.col("doc_id").alias("pull_request_id"),
        repo,
        F.concat(F.lit("old"), "quality").alias("last_reviewed_commit_sha"),
        F.lit(None).cast("timestamp").alias("updated_at"),
    )
    sha = F.concat(F.lit("c"), F.get_json_object("props", "$.k"))
    done = t(spark, d, "events").select(
        F.col("user_id").alias("pull_request_id"), repo, "event_id", sha.alias("last_reviewed_commit_sha")
    )
    newest = latest_by(done, ["repo_id", "pull_request_id"], "event_id")
    return state.record_reviews(stored, newest, _now()).select("pull_request_id", "last_reviewed_commit_sha")


@query(
    """SELECT l_orderkey AS usage_log_id, l_linenumber AS cost_usd_thousandths, NULL::VARCHAR AS comment_text,
  o_orderpriority AS command_name
FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""
)
def migrated_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables written by the first version, read as the current one."""
    old = {
        "llm_calls": t(spark, d, "lineitem").select(
            F.col("l_orderkey").alias("usage_log_id"), F.col("l_linenumber").alias("cost_usd_cents")
        ),
        "usage_logs": t(spark, d, "orders").select(
            F.col("o_orderkey").alias("usage_log_id"), F.col("o_orderpriority").alias("command_name")
        ),
        "test_suite": t(spark, d, "region"),
    }
    now = state.migrate(old)
    return now["llm_calls"].join(now["usage_logs"], "usage_log_id")


@query(
    ctes(LINKS)
    + """SELECT issue_id, pull_request_id FROM links
WHERE issue_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND pull_request_id IN (SELECT vec_id FROM embeddings)"""
)
def integrity_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """Links whose issue and change both exist."""
    issues = t(spark, d, "supplier").filter(F.col("s_acctbal") > 0).select(
        F.col("s_suppkey").alias("id"), F.lit(feeds.REPO).alias("repo_id")
    )
    pulls = feeds.vectors(spark, d, "id").select("id", "repo_id")
    kept = state.drop_orphans(_scored_links(spark, d), issues, {"repo_id": "repo_id", "issue_id": "id"})
    kept = state.drop_orphans(kept, pulls, {"repo_id": "repo_id", "pull_request_id": "id"})
    return kept.select("issue_id", "pull_request_id")


@query(
    """WITH pulls AS (SELECT vec_id AS id FROM embeddings WHERE vec_id % 3 <> 0),
issues AS (
  SELECT s_suppkey AS id, CASE WHEN s_suppkey + 1 IN (SELECT id FROM pulls) THEN s_suppkey + 1 END AS truth FROM supplier WHERE s_acctbal > 0),
links AS (SELECT DISTINCT l_suppkey AS issue, l_partkey AS pull FROM lineitem),
logs AS (SELECT o_orderkey AS id, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0))
SELECT 'issues' AS name, id AS a, truth AS b FROM issues
UNION ALL SELECT 'pull_request_embeddings', vec_id, NULL FROM embeddings WHERE vec_id IN (SELECT id FROM pulls)
UNION ALL SELECT 'issue_embeddings', vec_id, NULL FROM embeddings WHERE vec_id IN (SELECT id FROM issues)
UNION ALL SELECT 'issue_pull_request', issue, pull FROM links WHERE issue IN (SELECT id FROM issues) AND pull IN (SELECT id FROM pulls)
UNION ALL SELECT 'usage_logs', id, o_custkey FROM logs
UNION ALL SELECT 'llm_calls', l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT id FROM logs)"""
)
def integrity_tables(spark: SparkSession, d: str) -> DataFrame:
    """All tables after changes, issues and users were deleted with what hangs on them."""
    repo = F.lit(feeds.REPO).alias("repo_id")
    suppliers = t(spark, d, "supplier")
    tables = {
        "llm_calls": t(spark, d, "lineitem").select(F.col("l_orderkey").alias("usage_log_id"), F.col("l_linenumber").cast("long").alias("b")),
        "usage_logs": t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id")),
        "users": t(spark, d, "customer").select(F.col("c_custkey").alias("id")),
        "issue_pull_request": feeds.links(spark, d),
        "issue_embeddings": feeds.vectors(spark, d, "issue_id"),
        "pull_request_embeddings": feeds.vectors(spark, d, "pull_request_id"),
        "issues": suppliers.select(F.col("s_suppkey").alias("id"), repo, (F.col("s_suppkey") + 1).alias("actual_pull_request_id")),
        "pull_requests": feeds.vectors(spark, d, "id").select("id", "repo_id"),
    }
    tables = state.delete_cascade(tables, "pull_requests", tables["pull_requests"].where("id % 3 = 0"))
    tables = state.delete_cascade(tables, "issues", suppliers.where("s_acctbal <= 0").select(F.col("s_suppkey").alias("id"), repo))
    tables = state.delete_cascade(tables, "users", tables["users"].where("id % 5 = 0"))
    none = F.lit(None).cast("long")
    columns = {
        "issues": ("id", "actual_pull_request_id"), "pull_request_embeddings": ("pull_request_id", none), "issue_embeddings": ("issue_id", none),
        "issue_pull_request": ("issue_id", "pull_request_id"), "usage_logs": ("id", "user_id"), "llm_calls": ("usage_log_id", "b"),
    }
    parts = []
    for name, (a, b) in columns.items():
        second = F.col(b) if isinstance(b, str) else b
        parts.append(tables[name].select(F.lit(name).alias("name"), F.col(a).alias("a"), second.alias("b")))
    return reduce(DataFrame.unionByName, parts)
