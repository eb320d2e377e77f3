"""Preparing diffs for review and turning findings and answers into comments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import review_body
from tracewright.operators.diffs import changed_line_rows, describe_patches, has_patch, review_section, split_diffs
from tracewright.operators.paths import drop_ignored
from tracewright.operators.review import (
    at_least_medium,
    drop_near_security,
    findings_to_comments,
    merge_comments,
    normalise_findings,
    on_changed_lines,
    publishable,
    python_files,
    to_review_rows,
)

PULL = ["repo_id", "pull_request_id"]


@dataclass
class ReviewInput:
    files: DataFrame
    sections: DataFrame
    changed: DataFrame


def review_input(raw_diffs: DataFrame, patterns: DataFrame) -> ReviewInput:
    """Files of raw diffs that are not ignored, their numbered sections in order, and the changed lines."""
    parts = split_diffs(raw_diffs).withColumnRenamed("path", "filename")
    files = describe_patches(drop_ignored(parts, patterns))
    with_text = files.filter(has_patch(F.col("patch")))
    shown = review_section(
        F.col("filename"), F.col("status"), F.col("additions"), F.col("deletions"), F.col("patch")
    )
    sections = with_text.select(*PULL, "ord", "filename", shown.alias("section"))
    changed = changed_line_rows(with_text, [*PULL, "filename"]).withColumnRenamed("filename", "file")
    return ReviewInput(files, sections, changed)


def prompt_chunks(sections: DataFrame, size: int = 200) -> DataFrame:
    """The sections of each change joined to texts of at most ``size`` files, in order of ``chunk``.

    For files that come as rows. Chunks are ranges of ``ord``, so no ranking is needed and no list grows with the
    change. One raw diff per row needs no shuffle at all: see ``review_text``.
    """
    chunk = F.floor(F.col("ord") / size).alias("chunk")
    entry = F.struct("ord", "section")
    lists = sections.groupBy(*PULL, chunk).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    texts = F.transform("entries", lambda e: e["section"])
    return lists.select(*PULL, "chunk", F.array_join(texts, "\n\n").alias("text"))


@dataclass
class Review:
    comments: DataFrame
    rows: DataFrame
    bodies: DataFrame


def assemble_review(
    raw_findings: DataFrame, changed: DataFrame, comments: DataFrame, files: DataFrame, overviews: DataFrame
) -> Review:
    """Findings on changed lines and the other comments, merged, filtered and ready to post.

    Only Python files with a patch are scanned. ``overviews`` has repo_id, pull_request_id, code_overview and
    since_sha.
    """
    findings = at_least_medium(normalise_findings(python_files(raw_findings)))
    security = findings_to_comments(on_changed_lines(findings, changed))
    merged = merge_comments(security, drop_near_security(comments, security))
    bodies = overviews.select(*PULL, review_body(F.col("code_overview"), F.col("since_sha")).alias("body"))
    return Review(merged, to_review_rows(publishable(merged, files)), bodies)
