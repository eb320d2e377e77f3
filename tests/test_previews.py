"""Starts of source summaries against Python's own list texts."""

from __future__ import annotations

import os

from tracewright.functions.source import PREVIEW_CHARS
from tracewright.workloads import sources

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_previews_are_python_list_texts(spark):
    index = {r["path"]: r["lines"] for r in sources._index(spark, FOLDER).collect()}
    rows = sources.source_previews(spark, FOLDER).collect()
    assert len(rows) == len(index) > 0
    for r in rows:
        lines = index[r["path"]]
        assert (r["lines"], r["summary"]) == (len(lines), str(lines)[:PREVIEW_CHARS])
