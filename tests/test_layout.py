"""Results don't depend on how a table is cut into files, nor on repeated keys or broken pages."""

from __future__ import annotations

import os
import tempfile

import pytest
from compare import bag
from pyspark.sql import functions as F

import __spark_entry__ as registered
from tracewright.operators import ordering, state
from tracewright.schemas import DIFFSTAT_PAGE
from tracewright.sources import files

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def cut(spark):
    """The same tables, events as a folder of several files."""
    folder = tempfile.mkdtemp(prefix="cut-")
    for name in os.listdir(FOLDER):
        if not name.startswith("events"):
            os.symlink(f"{FOLDER}/{name}", f"{folder}/{name}")
    spark.read.parquet(f"{FOLDER}/events.parquet").repartition(4).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["event_stream_ledger", "incremental_review", "process_once", "review_backlog"])
def test_table_of_many_files(spark, cut, name):
    run = registered.queries()[name]
    one, many = run(spark, FOLDER), run(spark, cut)
    rows = one.collect()
    assert rows and bag(rows, one.columns) == bag(many.collect(), many.columns)


def test_numbers_with_small_files(spark):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "50")
    try:
        rows = ordering.sequence_rows(spark.range(1000).select(F.col("id").alias("x")), ["x"], 1).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert all(r.seq == r.x + 1 for r in rows) and len(rows) == 1000


def test_one_row_per_key(spark):
    current = spark.createDataFrame([(1, "old", 0), (2, "stays", 0)], "k long, v string, at long")
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (3, "x", 1), (3, "x", 1)], "k long, v string, at long")
    want = {(1, "b", 2), (2, "stays", 0), (3, "x", 1)}
    got = state.replace_rows(current, rows, ["k"], ["at"]).collect()
    assert len(got) == 3 and {tuple(r) for r in got} == want
    got = state.update_columns(current, rows, ["k"], ["v"], ["at"]).collect()
    assert len(got) == 2 and {tuple(r) for r in got} == {(1, "b", 0), (2, "stays", 0)}


def test_broken_page_is_told(spark):
    pages = spark.createDataFrame([(1, '{"values": []}'), (2, '{"values": [')], "page int, body string")
    values, rejected = files.page_values(pages, DIFFSTAT_PAGE)
    assert values.count() == 0 and [r.page for r in rejected.collect()] == [2]
