"""Filtering file rows by ignore patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions.globs import is_negated, is_pattern_line, last_match_ignores, pattern_regex

CHUNK = 200
SMALL_BYTES = 64 << 20


def most_bytes(patterns: DataFrame) -> int:
    """An upper bound for the size of all expressions, from one pass over the raw patterns.

    A character becomes at most five, and each pattern gets a fixed frame.
    """
    cost = F.octet_length("pattern") * 5 + F.octet_length("repo_id") + 64
    return patterns.agg(F.sum(cost)).first()[0] or 0


def pattern_runs(patterns: DataFrame) -> DataFrame:
    """Each repository's patterns as an ordered list of alternations of like sign.

    Last match wins, so neighbours of the same sign can be tried together: most repositories need one
    expression per file instead of one per pattern. Long runs are cut so no expression grows without end.
    """
    lines = patterns.filter(is_pattern_line(F.col("pattern"))).select(
        "repo_id",
        "ord",
        is_negated(F.col("pattern")).alias("negated"),
        pattern_regex(F.col("pattern")).alias("regex"),
    )
    by_repo = W.partitionBy("repo_id").orderBy("ord")
    flips = F.when(F.lag("negated").over(by_repo).eqNullSafe(F.col("negated")), 0).otherwise(1)
    runs = (
        lines.withColumn("flip", flips)
        .withColumn("run", F.sum("flip").over(by_repo))
        .withColumn("piece", F.floor(F.row_number().over(W.partitionBy("repo_id", "run").orderBy("ord")) / CHUNK))
        .groupBy("repo_id", "run", "piece", "negated")
        .agg(F.array_join(F.array_sort(F.collect_set("regex")), "|").alias("regex"))
    )
    return runs.groupBy("repo_id").agg(
        F.sort_array(F.collect_list(F.struct("run", "piece", "negated", "regex"))).alias("runs")
    )


def flag_ignored(
    files: DataFrame, patterns: DataFrame, path: str = "filename", limit: int = SMALL_BYTES
) -> DataFrame:
    """Add ``ignored`` to file rows, which may carry their patches.

    Pattern lists are one row per repository. They are broadcast when they are known to be small, so that the
    patches need not move, and joined by shuffle beyond that.
    """
    runs = pattern_runs(patterns)
    if most_bytes(patterns) <= limit:
        runs = F.broadcast(runs)
    joined = files.join(runs, "repo_id", "left")
    return joined.withColumn("ignored", last_match_ignores(F.col(path), F.col("runs"))).drop("runs")


def drop_ignored(files: DataFrame, patterns: DataFrame, path: str = "filename") -> DataFrame:
    return flag_ignored(files, patterns, path).filter(~F.col("ignored")).drop("ignored")
