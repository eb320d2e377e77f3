"""The files of a source tree are written by many tasks."""

from __future__ import annotations

import re

from tracewright.workloads import readers


def test_tasks_share_the_files_of_one_large_piece(spark, tmp_path, monkeypatch):
    # one row group: a scan of it is one task
    rows = [(i, f"https://h.test/{'de' if i % 2 else 'en'}/{i}", f"<p>{i}</p>") for i in range(60)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    read, seen = readers.files.read_source_tree, []

    def watched(session, folder):
        tree = session.read.text(folder, wholetext=True, recursiveFileLookup=True)
        seen.extend(r[0] for r in tree.selectExpr("_metadata.file_path").collect())
        return read(session, folder)

    monkeypatch.setattr(readers.files, "read_source_tree", watched)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few
    try:
        got = readers.source_tree_index(spark, str(tmp_path)).select("path").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == len({r["path"] for r in got}) == 60
    assert len(seen) == 60 and len({re.search(r"part-(\d+)", name)[1] for name in seen}) > 1
