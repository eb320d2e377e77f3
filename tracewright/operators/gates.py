"""Comment events: parsing, admission, projection and routing. All of it is row-wise, for tables and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.core import blank_to_null, first_filled
from tracewright.functions.text import classify_command, is_bot, mentions, signed_by_us, wants_rerun
from tracewright.operators.ordering import previous_in_group
from tracewright.schemas import BITBUCKET_COMMENT, BLOCKER_LABEL, GITHUB_COMMENT, SIGNATURE, STR, USER_TAG

CORRUPT = "_corrupt_record"
NO_OUTPUT = "default output"

# What each refused event is told.
BAD_JSON = "Invalid JSON payload"
WRONG_EVENT = "Unsupported event type"
WRONG_ACTION = "Not a comment action"
NO_INSTALLATION = "No installation ID found"
NO_SUBJECT = "No issue or pull request found"
NO_PULL_REQUEST = "No pull request found"
NO_COMMENT = "No comment found"


def parse_json(text: Column, schema: T.StructType) -> Column:
    """The text as a struct of ``schema`` with ``_corrupt_record`` set when it does not fit.

    A struct is never null for bad text, so whether it parsed is read from that field only.
    """
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, STR, True)])
    return F.from_json(text, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})


def parse_events(events: DataFrame, schema: T.StructType, body: str = "body") -> DataFrame:
    return events.withColumn("payload", parse_json(F.col(body), schema))


def _text(path: str) -> Column:
    return F.coalesce(F.col(path), F.lit(""))


def github_reject_reason(tag: str = USER_TAG) -> Column:
    """Why an event is refused, or null; the checks apply in this order."""
    installation = F.coalesce(F.col("payload.installation.id"), F.lit(0).cast("bigint"))
    subject = F.coalesce("payload.issue.number", "payload.pull_request.number")
    return (
        F.when(F.col("body").isNull() | F.col(f"payload.{CORRUPT}").isNotNull(), BAD_JSON)
        .when(~_text("event_type").isin("issue_comment"), WRONG_EVENT)
        .when(~_text("payload.action").isin("created", "edited"), WRONG_ACTION)
        .when(~mentions(_text("payload.comment.body"), tag), f"No {tag.lower()} mention")
        .when(installation == 0, NO_INSTALLATION)
        .when(subject.isNull(), NO_SUBJECT)
    )


def gate_github(events: DataFrame, tag: str = USER_TAG) -> DataFrame:
    """Events with ``event_type`` header and JSON ``body``, parsed, with ``reject_reason``."""
    parsed = parse_events(events, GITHUB_COMMENT)
    return parsed.withColumn("reject_reason", github_reject_reason(tag))


def project_github(gated: DataFrame) -> DataFrame:
    """Admitted comments of people as flat rows with command and route."""
    user, comment = "payload.comment.user", "payload.comment"
    people = gated.filter(F.col("reject_reason").isNull() & ~is_bot(F.col(f"{user}.type"), F.col(f"{user}.login")))
    on_issue = F.col("payload.issue").isNotNull() & F.col("payload.issue.number").isNotNull()
    pull_request = F.col("payload.issue.pull_request")
    kept = [c for c in gated.columns if c not in ("event_type", "body", "payload", "reject_reason")]
    flat = people.select(
        *kept,
        F.col("payload.repository.id").alias("repo_id"),
        F.when(on_issue, F.col("payload.issue.number"))
        .otherwise(F.col("payload.pull_request.number"))
        .alias("subject_number"),
        F.coalesce(
            F.when(on_issue, F.col("payload.issue.url")).otherwise(F.col("payload.pull_request.url")), F.lit("")
        ).alias("subject_url"),
        F.when(on_issue & pull_request.isNotNull(), "PullRequest").otherwise("Issue").alias("subject_type"),
        _text(f"{comment}.body").alias("comment_text"),
        _text(f"{comment}.url").alias("comment_url"),
        _text(f"{user}.login").alias("username"),
        _text(f"{user}.email").alias("email"),
        first_filled(F.col(f"{user}.name"), _text(f"{user}.login")).alias("name"),
        _text(f"{user}.avatar_url").alias("avatar_url"),
    )
    command = classify_command(F.col("comment_text"), F.col("subject_type"))
    return add_route(flat.withColumn("command_name", command))


def add_route(comments: DataFrame) -> DataFrame:
    """Ranking runs on issues and review on pull requests; anything else is ``unknown``."""
    command, subject = F.col("command_name"), F.col("subject_type")
    route = (
        F.when((command == "blame") & (subject == "Issue"), "blame")
        .when((command == "code_review") & (subject == "PullRequest"), "code_review")
        .otherwise("unknown")
    )
    return comments.withColumns({"route": route, "run_again": wants_rerun(F.col("comment_text"))})


def gate_bitbucket(events: DataFrame, tag: str = USER_TAG, signature: str = SIGNATURE) -> DataFrame:
    """Forwarded comment events with the fetched comment in the same ``body``."""
    parsed = parse_events(events, BITBUCKET_COMMENT)
    number = lambda path: F.coalesce(F.col(path), F.lit(0).cast("bigint"))
    text = _text("payload.content.raw")
    reason = (
        F.when(F.col("body").isNull() | F.col(f"payload.{CORRUPT}").isNotNull(), BAD_JSON)
        .when(number("payload.pullrequest.id") == 0, NO_PULL_REQUEST)
        .when(number("payload.comment.id") == 0, NO_COMMENT)
        .when((_text("payload.workspace.uuid") == "") | (_text("payload.repository.uuid") == ""), "missing fields")
        .when(~mentions(text, tag), f"No {tag.lower()} mention")
        .when(signed_by_us(text, signature), "own comment")
    )
    return parsed.withColumn("reject_reason", reason)


def project_bitbucket(gated: DataFrame) -> DataFrame:
    user = "payload.user"
    kept = [c for c in gated.columns if c not in ("body", "payload", "reject_reason")]
    flat = gated.filter(F.col("reject_reason").isNull()).select(
        *kept,
        F.col("payload.repository.uuid").alias("repo_id"),
        F.col("payload.pullrequest.id").alias("subject_number"),
        _text("payload.pullrequest.links.html.href").alias("subject_url"),
        F.lit("PullRequest").alias("subject_type"),
        _text("payload.content.raw").alias("comment_text"),
        _text("payload.links.html.href").alias("comment_url"),
        first_filled(F.col(f"{user}.nickname"), _text(f"{user}.uuid")).alias("username"),
        F.lit("").alias("email"),
        first_filled(F.col(f"{user}.display_name"), _text(f"{user}.nickname")).alias("name"),
        _text(f"{user}.links.avatar.href").alias("avatar_url"),
        F.lit("code_review").alias("command_name"),
    )
    return add_route(flat)


def issue_gate(requests: DataFrame, issues: DataFrame, label: str = BLOCKER_LABEL) -> DataFrame:
    """Requests with the verdict on their issue: already processed, not labelled, or admitted.

    ``requests`` has repo_id, issue_id and the labels read from the tracker; an issue we never stored
    counts as not processed.
    """
    known = issues.select("repo_id", F.col("id").alias("issue_id"), "is_processed")
    done = F.coalesce("is_processed", F.lit(False))
    verdict = (
        F.when(done, "already processed")
        .when(~F.coalesce(F.array_contains("labels", label), F.lit(False)), "not labeled")
        .otherwise("admitted")
    )
    return requests.join(known, ["repo_id", "issue_id"], "left").withColumn("verdict", verdict).drop("is_processed")


def review_gate(requests: DataFrame, reviews: DataFrame) -> DataFrame:
    """Review requests with ``skip`` and the commit to review from.

    ``requests`` has repo_id, pull_request_id, head_sha and run_again. A forced request reviews everything.
    """
    last = reviews.select("repo_id", "pull_request_id", F.col("last_reviewed_commit_sha").alias("last_sha"))
    joined = requests.join(last, ["repo_id", "pull_request_id"], "left")
    same = F.col("last_sha").eqNullSafe(F.col("head_sha"))
    return (
        joined.filter(blank_to_null(F.col("head_sha")).isNotNull())
        .withColumns({"skip": ~F.col("run_again") & same, "since_sha": F.when(~F.col("run_again"), F.col("last_sha"))})
        .drop("last_sha")
    )


def only_reachable(requests: DataFrame, commits: DataFrame) -> DataFrame:
    """Review everything where the commit to review from is gone, as after a forced push."""
    known = commits.select("repo_id", F.col("sha").alias("since_sha")).distinct().withColumn("_there", F.lit(True))
    joined = requests.join(known, ["repo_id", "since_sha"], "left")
    since = F.when(F.col("_there"), F.col("since_sha")).alias("since_sha")
    return joined.select(*[since if c == "since_sha" else F.col(c) for c in requests.columns])


def due_reviews(requests: DataFrame) -> DataFrame:
    """Past review requests that needed a review, each judged against the request before it.

    For a backlog in a table; events still arriving go through the stream of the same name. ``requests`` has
    repo_id, pull_request_id, event_id, ts, head_sha and forced.
    """
    valid = requests.filter(blank_to_null(F.col("head_sha")).isNotNull())
    ordered = previous_in_group(valid, ["repo_id", "pull_request_id"], ["ts", "event_id"], ["head_sha"])
    due = ordered.filter(F.col("forced") | ~F.col("prev_head_sha").eqNullSafe(F.col("head_sha")))
    return due.withColumn("since_sha", F.when(~F.col("forced"), F.col("prev_head_sha"))).drop("prev_head_sha")
