"""Record types and fixed dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

STR, LONG, INT, DOUBLE, BOOL, TS = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampType(),
)


def record(**fields: T.DataType) -> T.StructType:
    """A struct of nullable fields, in the order given."""
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


CULPRIT = record(pull_request_id=LONG, reason=STR)

PULL_REQUESTS = record(
    id=LONG,
    repo_id=STR,
    title=STR,
    test=STR,
    explanation=STR,
    files=T.ArrayType(STR),
    code_diff_summary=STR,
    linked_issue_ids=T.ArrayType(LONG),
    created_at=TS,
)
PULL_REQUEST_EMBEDDINGS = record(pull_request_id=LONG, repo_id=STR, embedding=T.ArrayType(DOUBLE), created_at=TS)
ISSUES = record(
    id=LONG,
    repo_id=STR,
    title=STR,
    steps=STR,
    raw_body=STR,
    labels=T.ArrayType(STR),
    is_processed=BOOL,
    culprit_pull_requests=T.ArrayType(CULPRIT),
    actual_pull_request_id=LONG,
    created_at=TS,
)
ISSUE_EMBEDDINGS = record(issue_id=LONG, repo_id=STR, embedding=T.ArrayType(DOUBLE), created_at=TS)
ISSUE_PULL_REQUEST = record(issue_id=LONG, pull_request_id=LONG, repo_id=STR, score=DOUBLE)
USERS = record(id=LONG, username=STR, name=STR, avatar_url=STR, email=STR, is_active=BOOL, created_at=TS)
USAGE_LOGS = record(
    id=LONG,
    user_id=LONG,
    command_name=STR,
    comment_url=STR,
    output=STR,
    issue_or_pull_request_url=STR,
    comment_text=STR,
    created_at=TS,
)
MODEL_CALLS = record(
    id=LONG, usage_log_id=LONG, llm_model=STR, tokens_used=LONG, cost_usd_thousandths=LONG, created_at=TS
)
PULL_REQUEST_REVIEWS = record(pull_request_id=LONG, repo_id=STR, last_reviewed_commit_sha=STR, updated_at=TS)

FILE_DIFF = record(filename=STR, status=STR, additions=INT, deletions=INT, patch=STR)
REVIEW_COMMENT = record(file=STR, line=INT, start_line=INT, content=STR, label=STR)
REVIEW = record(
    pr_number=LONG, comments=T.ArrayType(REVIEW_COMMENT), code_overview=STR, files_reviewed=T.ArrayType(STR)
)
FINDING = record(
    file_path=STR, line=INT, start_line=INT, severity=STR, rule_id=STR, description=STR, tool=STR
)
DIFFSTAT_PAGE = record(
    values=T.ArrayType(
        record(status=STR, lines_added=INT, lines_removed=INT, new=record(path=STR), old=record(path=STR))
    ),
    next=STR,
)
TOKEN_USAGE = record(input_tokens=LONG, output_tokens=LONG, output_token_details=record(reasoning=LONG))

GITHUB_COMMENT = record(
    action=STR,
    comment=record(
        body=STR, url=STR, user=record(type=STR, login=STR, email=STR, name=STR, avatar_url=STR)
    ),
    installation=record(id=LONG),
    repository=record(id=STR),
    issue=record(number=LONG, url=STR, pull_request=record(url=STR)),
    pull_request=record(number=LONG, url=STR),
)
BITBUCKET_COMMENT = record(
    workspace=record(uuid=STR),
    repository=record(uuid=STR),
    pullrequest=record(id=LONG, links=record(html=record(href=STR))),
    comment=record(id=LONG),
    content=record(raw=STR),
    user=record(nickname=STR, uuid=STR, display_name=STR, links=record(avatar=record(href=STR))),
    links=record(html=record(href=STR)),
)

# Command names, severities from low to high, comment labels, publishable labels.
COMMANDS = ("blame", "code_review", "unknown")
SEVERITIES = ("low", "medium", "high", "critical")
COMMENT_LABELS = (
    "nitpick",
    "suggestion",
    "issue",
    "todo",
    "thought",
    "chore",
    "note",
    "praise",
    "security",
)
PUBLISHED_LABELS = ("security", "issue", "suggestion")

# The label that admits an issue to ranking.
BLOCKER_LABEL = "DeployBlockerCash"

# Model name, USD per million input, output and reasoning tokens.
PRICING = (
    ("gpt-5-2025-08-07", 1.25, 10.0, 10.0),
    ("gpt-5-mini-2025-08-07", 0.25, 2.0, 2.0),
    ("gpt-5-nano-2025-08-07", 0.05, 0.4, 0.4),
)

# Settings of a deployment: the mention that calls the assistant and the mark it leaves in its own comments.
USER_TAG = "@tracewright"
SIGNATURE = "\n<!-- tracewright code reviewer -->"


def pricing_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(PRICING),
        "model string, input_per_million double, output_per_million double, reasoning_per_million double",
    )
