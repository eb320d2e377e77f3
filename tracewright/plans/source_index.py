"""Summaries of all files of a source tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.source import PREVIEW_CHARS, clean_source, file_summary, is_ignored_source
from tracewright.functions.text import py_list_repr


def index_sources(files: DataFrame) -> DataFrame:
    """``path, content`` to ``path, lines``, without ignored files."""
    kept = files.filter(~is_ignored_source(F.col("path")))
    cleaned = kept.select("path", clean_source(F.col("content")).alias("cleaned"))
    return cleaned.select("path", file_summary(F.col("path"), F.col("cleaned")).alias("lines"))


def preview(index: DataFrame) -> DataFrame:
    """Path, number of lines and the start of the list's text."""
    return index.select(
        "path",
        F.size("lines").alias("lines"),
        F.substring(py_list_repr(F.col("lines")), 1, PREVIEW_CHARS).alias("summary"),
    )


def longest_first(index: DataFrame) -> DataFrame:
    # a sort reads its input twice; the exchange makes the second read one of small rows, not of the sources
    sized = index.select("path", F.size("lines").alias("lines")).repartition("path")
    return sized.orderBy(F.desc("lines"), "path")
