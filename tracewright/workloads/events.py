"""Comment events, in tables and as streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import text
from tracewright.operators import gates
from tracewright.schemas import BLOCKER_LABEL, SIGNATURE, USER_TAG
from tracewright.session import scratch_path
from tracewright.streaming.job import comment_event_job as event_job
from tracewright.streaming.job import outcomes
from tracewright.streaming.ledger import comment_ledger, ledger_tables
from tracewright.streaming.reviews import DUE, PROCESSED, issue_stream, review_stream
from tracewright.streaming.tables import BatchTables
from tracewright.workloads import feeds
from tracewright.workloads.base import ctes, query, t
from tracewright.workloads.feeds import EVENT_REASON


@query(ctes(EVENT_REASON) + "SELECT conv_id, turn, reject_reason FROM events_in")
def comment_gate(spark: SparkSession, d: str) -> DataFrame:
    return gates.gate_github(feeds.comment_events(spark, d)).select("conv_id", "turn", "reject_reason")


WINDOW = rf"""mention_words AS (
  SELECT *, list_filter(string_split_regex(comment_text, '[\s\x{{85}}\x{{a0}}]+'), lambda w: w <> '') AS ws FROM events_in),
mention_at AS (
  SELECT *, coalesce(list_position(list_transform(ws, lambda w: contains(lower(w), '{USER_TAG}')), true), 0) AS spot
  FROM mention_words),
contexts AS (
  SELECT *, array_to_string(CASE WHEN spot > 0 THEN ws[greatest(spot - 10, 1):spot + 19] ELSE ws[1:50] END, ' ') AS context
  FROM mention_at)"""
COMMANDS = rf"""commands AS (
  SELECT *, replace(lower(context), '{USER_TAG}', ' ') AS plain,
    CASE WHEN role = 'assistant' THEN 'PullRequest' ELSE 'Issue' END AS subject_type
  FROM contexts),
classified AS (
  SELECT *, CASE
    WHEN regexp_matches(plain, '\b(?:culprit|which pr|find pr|cause)') AND regexp_matches(plain, '\b(?:review|feedback|analyze pr)')
      THEN CASE WHEN subject_type = 'PullRequest' THEN 'code_review' ELSE 'blame' END
    WHEN regexp_matches(plain, '\b(?:culprit|which pr|find pr|cause)') THEN 'blame'
    WHEN regexp_matches(plain, '\b(?:review|feedback|analyze pr)') THEN 'code_review' ELSE 'unknown' END AS command_name,
    len(list_filter(list_transform(ws, lambda w: lower(w)), lambda w: w IN ('again', 'full', 'complete'))) > 0 AS run_again
  FROM commands)"""


def _comments(spark: SparkSession, d: str) -> DataFrame:
    """Event text without its envelope, for every conversation turn."""
    rows = t(spark, d, "conversations")
    body = (
        F.when(F.col("role") == "user", F.concat("text", F.lit(f" {USER_TAG} Which PR is the culprit? AGAIN")))
        .when(F.col("role") == "assistant", F.concat(F.lit(f"{USER_TAG.upper()} please review full "), "text"))
        .otherwise(F.col("text"))
    )
    subject = F.when(F.col("role") == "assistant", "PullRequest").otherwise("Issue")
    return rows.select("conv_id", "turn", body.alias("body"), subject.alias("subject"))


@query(ctes(EVENT_REASON, WINDOW) + "SELECT conv_id, turn, context FROM contexts")
def mention_context(spark: SparkSession, d: str) -> DataFrame:
    return _comments(spark, d).select("conv_id", "turn", text.mention_context(F.col("body")).alias("context"))


@query(ctes(EVENT_REASON, WINDOW, COMMANDS) + "SELECT conv_id, turn, run_again FROM classified")
def rerun_flag(spark: SparkSession, d: str) -> DataFrame:
    return _comments(spark, d).select("conv_id", "turn", text.wants_rerun(F.col("body")).alias("run_again"))


@query(ctes(EVENT_REASON, WINDOW, COMMANDS) + "SELECT conv_id, turn, command_name FROM classified")
def command_class(spark: SparkSession, d: str) -> DataFrame:
    command = text.classify_command(F.col("body"), F.col("subject"))
    return _comments(spark, d).select("conv_id", "turn", command.alias("command_name"))


@query(
    ctes(EVENT_REASON, WINDOW, COMMANDS)
    + """SELECT conv_id, turn, '42' AS repo_id, conv_id AS subject_number, subject_type, command_name, run_again,
  'https://tracker.test/c/' || conv_id || '/' || turn AS comment_url, 'User' || conv_id AS username,
  CASE WHEN turn = 0 THEN 'User' || conv_id ELSE 'A Name' END AS name, '' AS email,
  CASE WHEN command_name = 'blame' AND subject_type = 'Issue' THEN 'blame'
    WHEN command_name = 'code_review' AND subject_type = 'PullRequest' THEN 'code_review' ELSE 'unknown' END AS route
FROM classified WHERE reject_reason IS NULL AND turn NOT IN (3, 5)"""
)
def comment_routes(spark: SparkSession, d: str) -> DataFrame:
    """Admitted comments of people, projected, classified and routed."""
    rows = gates.project_github(gates.gate_github(feeds.comment_events(spark, d)))
    return rows.drop("comment_text", "subject_url", "avatar_url")


@query(
    f"""SELECT conv_id, turn, CASE WHEN turn = 4 THEN 'No pull request found' WHEN turn = 3 THEN 'No comment found'
  WHEN role = 'system' THEN 'missing fields' WHEN turn = 2 THEN 'No {USER_TAG} mention'
  WHEN turn = 1 THEN 'own comment' END AS reject_reason FROM conversations"""
)
def bitbucket_gate(spark: SparkSession, d: str) -> DataFrame:
    turn = F.col("turn")
    said = F.concat("text", F.when(turn != 2, f" {USER_TAG}").otherwise(""), F.when(turn == 1, SIGNATURE).otherwise(""))
    payload = F.struct(
        F.struct(F.lit("{w}").alias("uuid")).alias("workspace"),
        F.struct(F.when(F.col("role") == "system", "").otherwise("{r}").alias("uuid")).alias("repository"),
        F.struct(F.when(turn != 4, F.col("conv_id") + 1).alias("id")).alias("pullrequest"),
        F.struct(F.when(turn != 3, turn + 1).alias("id")).alias("comment"),
        F.struct(said.alias("raw")).alias("content"),
    )
    rows = t(spark, d, "conversations").select("conv_id", "turn", F.to_json(payload).alias("body"))
    return gates.gate_bitbucket(rows).select("conv_id", "turn", "reject_reason")


@query(
    """SELECT conv_id, turn, role = 'assistant' OR turn = 5 AS bot FROM conversations"""
)
def bot_filter(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("role") == "assistant", "BOT").otherwise("User")
    login = F.when(F.col("turn") == 5, "helper[Bot]").otherwise("helper")
    return t(spark, d, "conversations").select("conv_id", "turn", text.is_bot(kind, login).alias("bot"))


# --- streams over the events table

BATCH_BYTES = 4 << 30


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = t(spark, d, "events").schema
    # the batch limit bounds what one key can bring into one call of a stateful operator
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", BATCH_BYTES)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    # a stream reads folders: that of the table's part files, or the one around a table of a single file
    rows = reader.parquet(f"{d}/events.parquet") if folder else reader.option("pathGlobFilter", "events.parquet").parquet(d)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _event_bodies(events: DataFrame, tail: Column | None = None, rest: Sequence[Column] = ()) -> DataFrame:
    """Events as the host sends them; ``tail`` is said at the end, ``rest`` stands beside the body."""
    kind = F.col("event_type")
    said = (
        F.when(kind == "purchase", f"{USER_TAG} review this")
        .when(kind == "click", f"{USER_TAG} which pr is the culprit")
        .when(kind == "signup", f"hello {USER_TAG}")
        .when(kind == "view", "no mention")
        .otherwise(f"{USER_TAG} again")
    )
    payload = F.struct(
        F.when(kind == "error", "deleted").otherwise("created").alias("action"),
        F.struct(
            (said if tail is None else F.concat(said, tail)).alias("body"),
            F.concat(F.lit("https://tracker.test/c/"), "event_id").alias("url"),
            F.struct(F.concat(F.lit("user"), "user_id").alias("login")).alias("user"),
        ).alias("comment"),
        F.struct(F.lit(1).alias("id")).alias("installation"),
        F.struct(F.lit(9).alias("id")).alias("repository"),
        F.struct(
            F.col("user_id").alias("number"), F.when(kind == "purchase", F.struct(F.lit("u").alias("url"))).alias("pull_request")
        ).alias("issue"),
    )
    return events.select("event_id", "ts", F.lit("issue_comment").alias("event_type"), F.to_json(payload).alias("body"), *rest)


@query(
    """WITH admitted AS (
  SELECT *, 'user' || user_id AS username FROM events WHERE event_type IN ('purchase', 'click', 'signup')),
firsts AS (SELECT DISTINCT ON (username) username, ts, event_id FROM admitted ORDER BY username, ts, event_id),
known AS (SELECT username, row_number() OVER (ORDER BY ts, event_id) AS user_id FROM firsts)
SELECT row_number() OVER (ORDER BY ts, event_id) AS id, k.user_id, a.username,
  CASE event_type WHEN 'purchase' THEN 'code_review' WHEN 'click' THEN 'blame' ELSE 'unknown' END AS command_name,
  'https://tracker.test/c/' || event_id AS comment_url, ts AS created_at
FROM admitted a JOIN known k ON k.username = a.username"""
)
def event_stream_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The event stream through gate, user and usage tables; what the tables hold afterwards."""
    root = scratch_path(spark, "ledger")
    comments = gates.project_github(gates.gate_github(_event_bodies(_stream(spark, d))))
    comment_ledger(comments, root, ["ts", "event_id"]).awaitTermination()
    users, logs = ledger_tables(spark, root)
    people = users.select(F.col("id").alias("user_id"), "username")
    return logs.join(people, "user_id").select(
        "id", "user_id", "username", "command_name", "comment_url", F.col("created_at").cast("timestamp_ntz").alias("created_at")
    )


DUE_SQL = """WITH heads AS (
  SELECT event_id, user_id, json_extract_string(props, '$.k')::BIGINT // 25 AS sha, event_type = 'purchase' AS forced,
    lag(json_extract_string(props, '$.k')::BIGINT // 25) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before
  FROM events)
SELECT event_id, user_id AS pull_request_id, 'c' || sha AS head_sha, CASE WHEN NOT forced THEN 'c' || before END AS since_sha, forced
FROM heads WHERE forced OR before IS NULL OR before <> sha"""


def _review_requests(events: DataFrame) -> DataFrame:
    commit = F.floor(F.get_json_object("props", "$.k").cast("bigint") / 25)
    return events.select(
        F.lit(feeds.REPO).alias("repo_id"),
        F.col("user_id").alias("pull_request_id"),
        "event_id",
        "ts",
        F.concat(F.lit("c"), commit.cast("string")).alias("head_sha"),
        (F.col("event_type") == "purchase").alias("forced"),
    )


DUE_COLUMNS = ["event_id", "pull_request_id", "head_sha", "since_sha", "forced"]


@query(DUE_SQL)
def incremental_review(spark: SparkSession, d: str) -> DataFrame:
    """Review requests as a stream with the last commit of each pull request as state."""
    root = scratch_path(spark, "reviews")
    review_stream(_review_requests(_stream(spark, d)), root).awaitTermination()
    return BatchTables(spark, root).read("due", DUE).select(*DUE_COLUMNS)


@query(DUE_SQL)
def review_backlog(spark: SparkSession, d: str) -> DataFrame:
    """The same requests as a finished table."""
    return gates.due_reviews(_review_requests(t(spark, d, "events"))).select(*DUE_COLUMNS)


# An issue is labelled from k = 30 on; it has culprits if its customer has an urgent order, the dearest three.
def _ranker(spark: SparkSession, d: str):
    urgent = t(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    order = F.struct(-F.col("o_totalprice"), "o_orderkey")

    def rank(issues: DataFrame) -> DataFrame:
        found = urgent.join(issues, F.col("o_custkey") == F.col("issue_id")).groupBy("repo_id", "issue_id")
        best = found.agg(F.slice(F.sort_array(F.collect_list(order)), 1, 3).alias("best"))
        return best.select("repo_id", "issue_id", F.transform("best", lambda b: b["o_orderkey"]).alias("culprits"))

    return rank


def _labels() -> Column:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return F.when(k >= 30, F.array(F.lit("bug"), F.lit(BLOCKER_LABEL))).otherwise(F.array(F.lit("bug")))


FIRSTS = """urgent AS (SELECT DISTINCT o_custkey AS issue_id FROM orders WHERE o_orderpriority = '1-URGENT'),
asked AS (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events),"""


@query(
    "WITH " + FIRSTS + """
best AS (SELECT o_custkey AS issue_id, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)[1:3] AS culprits
  FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey)
SELECT issue_id, event_id, culprits FROM (SELECT DISTINCT ON (user_id) user_id, event_id FROM asked WHERE k >= 30 ORDER BY user_id, ts, event_id) f
JOIN best ON issue_id = user_id"""
)
def process_once(spark: SparkSession, d: str) -> DataFrame:
    """Ranking requests as a stream; each issue is processed once, by its first labelled request that finds culprits."""
    requests = _stream(spark, d).select(F.lit(feeds.REPO).alias("repo_id"), F.col("user_id").alias("issue_id"), "event_id", "ts", _labels().alias("labels"))
    root = scratch_path(spark, "once")
    issue_stream(requests, root, _ranker(spark, d)).awaitTermination()
    return BatchTables(spark, root).read("processed", PROCESSED).select("issue_id", "event_id", "culprits")


def _job_comments(events: DataFrame) -> DataFrame:
    """Projected comments with the labels of their issue and the head of their change; every tenth event asks for a full review."""
    commit = F.floor(F.get_json_object("props", "$.k").cast("bigint") / 25).cast("string")
    rest = [_labels().alias("labels"), F.concat(F.lit("c"), commit).alias("head_sha")]
    full = F.when(F.col("event_id") % 10 == 0, " full").otherwise("")
    return gates.project_github(gates.gate_github(_event_bodies(events, full, rest)))


JOB_SQL = (
    "WITH "
    + FIRSTS
    + """
admitted AS (
  SELECT *, row_number() OVER (ORDER BY ts, event_id) AS log_id, 'user' || user_id AS username,
    CASE event_type WHEN 'purchase' THEN 'code_review' WHEN 'click' THEN 'blame' ELSE 'unknown' END AS route
  FROM asked WHERE event_type IN ('purchase', 'click', 'signup')),
success AS (
  SELECT DISTINCT ON (user_id) user_id, ts, event_id FROM admitted SEMI JOIN urgent ON issue_id = user_id
  WHERE route = 'blame' AND k >= 30 ORDER BY user_id, ts, event_id),
heads AS (
  SELECT event_id, 'c' || (k // 25) AS sha, event_id % 10 = 0 AS forced,
    lag('c' || (k // 25)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before
  FROM admitted WHERE route = 'code_review')
SELECT a.event_id, log_id, username, route,
  CASE route WHEN 'unknown' THEN 'unknown'
    WHEN 'blame' THEN CASE WHEN (a.ts, a.event_id) > (s.ts, s.event_id) THEN 'already processed' WHEN k < 30 THEN 'not labeled'
      WHEN s.event_id IS NOT NULL THEN 'processed' ELSE 'no culprits' END
    ELSE CASE WHEN forced OR before IS NULL OR before <> sha THEN 'review' ELSE 'skip' END END AS outcome,
  CASE WHEN route = 'code_review' AND NOT forced AND before <> sha THEN before END AS since_sha
FROM admitted a LEFT JOIN success s ON s.user_id = a.user_id LEFT JOIN heads h ON h.event_id = a.event_id"""
)


@query(JOB_SQL)
def comment_event_job(spark: SparkSession, d: str) -> DataFrame:
    """The event stream through gate, ledger, rankings and reviews; what became of each admitted comment."""
    root = scratch_path(spark, "job")
    event_job(_job_comments(_stream(spark, d)), root, _ranker(spark, d)).awaitTermination()
    return outcomes(spark, root)
