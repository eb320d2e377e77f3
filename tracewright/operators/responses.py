"""JSON columns: stored lists and structured answers of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.core import blank_to_null
from tracewright.operators.gates import CORRUPT, parse_json
from tracewright.schemas import COMMANDS, COMMENT_LABELS, CULPRIT, LONG, REVIEW, REVIEW_COMMENT, STR, record

# kind of answer -> shape
ANSWERS = {
    "command": record(command_name=STR),
    "culprits": record(issue_id=LONG, pull_requests=T.ArrayType(CULPRIT)),
    "summary": record(pull_request_description=STR),
    "review": REVIEW,
    "kept_comments": record(filtered_code_review_comments=T.ArrayType(REVIEW_COMMENT)),
}


def to_json_list(items: Column) -> Column:
    """A list as JSON text; null for an empty or missing list."""
    return F.when(F.size(items) > 0, F.to_json(items))


def from_json_list(text: Column, item: str) -> Column:
    """A stored JSON list; missing text is an empty list."""
    empty = F.array().cast(f"array<{item}>")
    return F.coalesce(F.from_json(blank_to_null(text), f"array<{item}>"), empty)


def _comments_ok(items: Column) -> Column:
    """Every comment has its required fields and a known label."""
    bad = lambda c: (
        c["file"].isNull()
        | c["line"].isNull()
        | c["content"].isNull()
        | ~F.coalesce(c["label"].isin(*COMMENT_LABELS), F.lit(False))
    )
    return ~F.exists(items, bad)


def _valid(kind: str) -> Column:
    field = lambda name: F.col(f"answer.{name}")
    if kind == "command":
        return field("command_name").isin(*COMMANDS)
    if kind == "culprits":
        incomplete = lambda c: c["pull_request_id"].isNull() | c["reason"].isNull()
        return field("issue_id").isNotNull() & ~F.exists(field("pull_requests"), incomplete)
    if kind == "summary":
        return field("pull_request_description").isNotNull()
    if kind == "review":
        complete = field("pr_number").isNotNull() & field("code_overview").isNotNull()
        return complete & F.coalesce(_comments_ok(field("comments")), F.lit(True))
    return _comments_ok(field("filtered_code_review_comments"))


def parse_answers(responses: DataFrame, kind: str, column: str = "response") -> DataFrame:
    """Answers as a struct ``answer``, with ``accepted`` false for text that does not fit its shape."""
    parsed = responses.withColumn("answer", parse_json(F.col(column), ANSWERS[kind]))
    fits = F.col(f"answer.{CORRUPT}").isNull() & F.col(column).isNotNull() & _valid(kind)
    return parsed.withColumn("accepted", F.coalesce(fits, F.lit(False)))


def culprit_rows(issues: DataFrame, column: str = "culprit_pull_requests") -> DataFrame:
    """One row per culprit of each issue; issues without any keep one row of nulls."""
    kept = [c for c in issues.columns if c != column]
    return issues.select(*kept, F.posexplode_outer(column).alias("place", "culprit")).select(
        *kept, "place", "culprit.pull_request_id", "culprit.reason"
    )
