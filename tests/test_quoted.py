"""Quoted line ends across the pieces of one file."""

from __future__ import annotations

import csv
import io
import random

import pytest

from tracewright.sources import files, quoted


def write(path, rows, end="\r\n", header=("id", "note", "n")):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerow(header)
    w.writerows(rows)
    path.write_bytes(out.getvalue().encode())


def rows_of(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    bits = ["a", "b c", '"', '""', "\n", "\r\n", ",", "é", "\n\n", "'", "x" * 30]
    return [(seed * 10_000 + i, "z" + "".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) + "z", i % 7) for i in range(n)]


@pytest.mark.parametrize("piece", ["64", "997", "128m"])
def test_records_do_not_depend_on_the_pieces(spark, tmp_path, piece):
    all_rows = []
    for k, end in enumerate(("\n", "\r\n", "\n")):
        rows = rows_of(k + 1, 80 if k else 200)
        write(tmp_path / f"{k}.csv", rows, end)
        all_rows += rows
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    spark.conf.set(keys[0], piece)
    spark.conf.set(keys[1], "1")
    try:
        df = quoted.read_quoted_csv(spark, str(tmp_path), "id long, note string, n int")
        if piece == "997":
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8  # one file is read by many tasks
        got = sorted(tuple(r) for r in df.collect())
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)
    assert got == sorted(all_rows)


def test_headers_are_checked_and_empty_files_are_empty(spark, tmp_path):
    write(tmp_path / "a.csv", [], header=("id", "other"))
    with pytest.raises(ValueError, match="other"):
        quoted.read_quoted_csv(spark, str(tmp_path / "a.csv"), "id long, note string")
    assert quoted.read_quoted_csv(spark, str(tmp_path / "a.csv"), "id long, other string").count() == 0


def test_blockers_drop_the_free_text(spark, tmp_path):
    head = ("StagingDeployCash Issue", "StagingDeployCash Issue Number", "StagingDeployCash GitHub URL", "StagingDeployCash Created At")
    write(tmp_path / "b.csv", [('two\nlines, "quoted"', 1, "u", "2024-01-06T10:00:00Z"), ("", 2, "", "2024-02-06T10:00:00Z")], header=head)
    rows = files.read_blockers(spark, str(tmp_path / "b.csv")).orderBy("deploy_number").collect()
    assert [(r["deploy_number"], r["deploy_url"], r["created_at"].month) for r in rows] == [(1, "u", 1), (2, None, 2)]


def test_a_task_holds_few_lines_in_order(spark, tmp_path, monkeypatch):
    """However large a block is, its lines are dealt out in short runs; records may span any number of them."""
    rows = [*rows_of(1, 150), (2, "\n" * 40, 0), *rows_of(3, 50)]
    write(tmp_path / "a.csv", rows, "\r\n")
    write(tmp_path / "b.csv", rows_of(4, 30), "\n")
    schema = "id long, note string, n int"
    places = [tuple(r) for r in quoted.record_texts(spark, str(tmp_path)).select("file", "block", "line", "text").collect()]
    monkeypatch.setattr(quoted, "PIECE_LINES", 8)
    cut = quoted.record_texts(spark, str(tmp_path))
    assert sorted(tuple(r) for r in cut.select("file", "block", "line", "text").collect()) == sorted(places)
    assert "windowspecdefinition(file" in (plan := cut._jdf.queryExecution().optimizedPlan().toString()) and "run#" in plan
    got = sorted(tuple(r) for r in quoted.read_quoted_csv(spark, str(tmp_path), schema).collect())
    assert got == sorted([*rows, *rows_of(4, 30)])
