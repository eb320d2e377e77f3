"""Scanner findings and review comments on changed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.core import bind
from tracewright.functions.text import concern_words
from tracewright.schemas import COMMENT_LABELS, PUBLISHED_LABELS, SEVERITIES, SIGNATURE

PULL = ["repo_id", "pull_request_id"]
NEARBY = 3
#: Least share of the smaller remark's words that two remarks on one concern have in common.
OVERLAP = 0.5
COMMENT = ["file", "line", "start_line", "content", "label"]


def severity_rank(severity: Column) -> Column:
    """1 for low to 4 for critical; null for anything else."""
    ranks = F.array(*[F.lit(s) for s in SEVERITIES])
    return F.nullif(F.array_position(ranks, F.lower(severity)), F.lit(0).cast("bigint"))


def normalise_findings(raw: DataFrame, tool: str = "bandit") -> DataFrame:
    """Scanner rows in our shape: the last line of the range, the first one only when there are several."""
    lines = F.coalesce(F.col("line_range"), F.array("line_number"))
    return raw.select(
        *PULL,
        F.when(F.startswith("filename", F.lit("./")), F.substr("filename", F.lit(3)))
        .otherwise(F.col("filename"))
        .alias("file_path"),
        F.array_max(lines).alias("line"),
        F.when(F.size(lines) > 1, F.array_min(lines)).alias("start_line"),
        F.lower("issue_severity").alias("severity"),
        F.col("test_id").alias("rule_id"),
        F.col("issue_text").alias("description"),
        F.lit(tool).alias("tool"),
    )


def at_least_medium(findings: DataFrame) -> DataFrame:
    return findings.filter(severity_rank(F.col("severity")) >= 2)


def python_files(files: DataFrame, path: str = "filename") -> DataFrame:
    return files.filter(F.endswith(path, F.lit(".py")))


def on_changed_lines(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings whose last line was changed. The line set is made distinct before it meets the findings."""
    lines = changed.select(*PULL, F.col("file").alias("file_path"), "line").distinct()
    return findings.join(lines, [*PULL, "file_path", "line"], "left_semi")


def findings_to_comments(findings: DataFrame) -> DataFrame:
    text = F.concat(
        F.upper("severity"), F.lit(": "), "description",
        F.lit(" (Rule: "), "tool", F.lit(" "), "rule_id", F.lit(")"),
    )
    return findings.select(
        *PULL,
        F.col("file_path").alias("file"),
        "line",
        "start_line",
        text.alias("content"),
        F.lit("security").alias("label"),
    )


def drop_near_security(comments: DataFrame, security: DataFrame, nearby: int = NEARBY, overlap: float = OVERLAP) -> DataFrame:
    """Comments without those that repeat a security comment: same file, at most ``nearby`` lines apart, similar concern.

    Two remarks are similar when they share at least ``overlap`` of the words of the one that has fewer (see ``concern_words``); remarks
    without words are like no other. The security side is made distinct by line and words and its band spelled out, so the join stays an
    equality whose matches only test word sets; it emits no pairs, and the first match settles a comment. The words of a comment are
    looked for where it meets a security comment, as most meet none.
    """
    offsets = F.array(*[F.lit(d) for d in range(-nearby, nearby + 1)])
    band = (
        security.select(*PULL, "file", "line", concern_words(F.col("content")).alias("words"))
        .distinct()
        .select(*PULL, "file", F.explode(F.transform(offsets, lambda d: F.col("line") + d)).alias("line"), "words")
        .distinct()
    )
    c, s = comments.alias("c"), band.alias("s")

    def similar(said: Column) -> Column:
        fewer = F.least(F.size(said), F.size("s.words"))
        return (fewer > 0) & (F.size(F.array_intersect(said, F.col("s.words"))) >= overlap * fewer)

    same = [F.col(f"c.{k}") == F.col(f"s.{k}") for k in (*PULL, "file", "line")]
    return c.join(s, [*same, bind(concern_words(F.col("c.content")), similar)], "left_anti")


def merge_comments(security: DataFrame, comments: DataFrame) -> DataFrame:
    """Security comments first, then the others; ``source`` keeps that order."""
    first = security.select(F.lit(0).alias("source"), *PULL, *COMMENT)
    return first.unionByName(comments.select(F.lit(1).alias("source"), *PULL, *COMMENT))


def known_labels(comments: DataFrame) -> DataFrame:
    return comments.filter(F.col("label").isin(*COMMENT_LABELS))


def publishable(comments: DataFrame, files: DataFrame) -> DataFrame:
    """Comments with a published label on a file of the change."""
    paths = files.select(*PULL, F.col("filename").alias("file")).distinct()
    return comments.filter(F.col("label").isin(*PUBLISHED_LABELS)).join(paths, [*PULL, "file"], "left_semi")


def to_review_rows(comments: DataFrame, signature: str = SIGNATURE) -> DataFrame:
    """Comments as they are posted; a start line is kept only when it is a line above the end."""
    start = F.col("start_line")
    ranged = (start != 0) & (start < F.col("line"))
    body = F.concat(F.lit("**"), "label", F.lit("**: "), "content", F.lit(signature))
    other = [c for c in comments.columns if c not in COMMENT]
    return comments.select(
        *other,
        F.col("file").alias("path"),
        body.alias("body"),
        "line",
        F.lit("RIGHT").alias("side"),
        F.when(ranged, start).alias("start_line"),
        F.when(ranged, F.lit("RIGHT")).alias("start_side"),
    )


def comment_json(items: Column) -> Column:
    """Comments as compact JSON, keeping nulls."""
    return F.to_json(items, {"ignoreNullFields": "false"})
