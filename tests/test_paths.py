"""Ignore patterns: single patterns, and the last match over pooled lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions.globs import pattern_regex
from tracewright.functions.source import is_ignored_source, tree_path
from tracewright.operators.paths import drop_ignored, flag_ignored, most_bytes

SINGLE = [
    ("*.log", ["a.log", "x/y.log", "x.log/z"], ["a.logs", "log"]),
    ("/build", ["build", "build/a"], ["x/build"]),
    ("build/", ["build/a", "x/build/a"], ["build", "x/build"]),
    ("doc/*.txt", ["doc/a.txt"], ["x/doc/a.txt", "doc/b/a.txt"]),
    ("**/foo", ["foo", "a/b/foo", "foo/x"], ["afoo"]),
    ("a/**/b", ["a/b", "a/x/b", "a/x/y/b/c"], ["a/xb", "x/a/b"]),
    ("abc/**", ["abc/x", "abc/x/y"], ["abc", "x/abc/y"]),
    ("f?.c", ["f1.c", "x/ab/fz.c"], ["f.c", "f/.c"]),
    ("m[0-3].py", ["m0.py", "m3.py"], ["m4.py"]),
    ("m[!0-3].py", ["m4.py"], ["m1.py"]),
    (r"\!keep", ["!keep"], ["keep"]),
    (r"\#x", ["#x"], ["x"]),
    ("a+(b)", ["a+(b)"], ["aab"]),
    ("  padded  ", ["padded"], ["x padded"]),
    ("node_modules", ["node_modules/a/b", "x/node_modules"], ["node_modules2"]),
]


def test_single_patterns(spark):
    rows = [(p, path, hit) for p, yes, no in SINGLE for hit, paths in ((True, yes), (False, no)) for path in paths]
    df = spark.createDataFrame(rows, "pattern string, path string, want boolean")
    hit = F.call_function("regexp_instr", F.col("path"), pattern_regex(F.col("pattern"))) > 0
    wrong = df.withColumn("got", hit).filter("got <> want").collect()
    assert wrong == []


def test_last_match_wins(spark):
    patterns = spark.createDataFrame(
        [("r", 1, "*.py"), ("r", 2, "!keep.py"), ("r", 3, " #*.md"), ("r", 4, "#*.md"), ("r", 5, "  "), ("r", 7, "/"), ("r", 8, "\t!late.py"),
         ("r", 6, "lib/keep.py"), ("s", 1, "!*.py"), ("s", 2, "*.md")],
        "repo_id string, ord int, pattern string",
    )
    files = spark.createDataFrame(
        [("r", "a.py"), ("r", "keep.py"), ("r", "lib/keep.py"), ("r", "#a.md"), ("r", "late.py"), ("s", "a.py"), ("s", "x/a.md"), ("t", "a.py")],
        "repo_id string, filename string",
    )
    got = {(r["repo_id"], r["filename"]): r["ignored"] for r in flag_ignored(files, patterns).collect()}
    assert [k for k, v in got.items() if v] and {k for k, v in got.items() if v} == {
        ("r", "a.py"), ("r", "lib/keep.py"), ("s", "x/a.md"),
    }
    assert drop_ignored(files, patterns).count() == 5


def test_long_lists_are_cut_but_whole(spark):
    patterns = spark.range(1, 1001).selectExpr("'r' AS repo_id", "cast(id AS int) AS ord", "concat('f', id, '.x') AS pattern")
    files = spark.range(0, 1003).selectExpr("'r' AS repo_id", "concat('d/f', id, '.x') AS filename")
    assert flag_ignored(files, patterns).filter("ignored").count() == 1000


def test_broadcast_needs_a_small_side(spark):
    patterns = spark.createDataFrame([("r", 1, "*.x"), ("s", 1, "y")], "repo_id string, ord int, pattern string")
    files = spark.createDataFrame([("r", "a.x"), ("s", "a.x"), ("s", "y")], "repo_id string, filename string")
    assert most_bytes(patterns) == 4 * 5 + 2 + 128
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans, rows = [], []
        for limit in (1000, 10):
            flagged = flag_ignored(files, patterns, limit=limit)
            plans.append(flagged._jdf.queryExecution().executedPlan().toString())
            rows.append(sorted(tuple(r) for r in flagged.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plans[0] and "BroadcastHashJoin" not in plans[1]
    assert rows[0] == rows[1] == [("r", "a.x", True), ("s", "a.x", False), ("s", "y", True)]


def test_source_paths(spark):
    rows = [
        ("/home/x/src/libs/a.ts", "src/libs/a.ts", False),
        ("/x/src/typesX/a.ts", "src/typesX/a.ts", True),
        ("src/libs/DateUtils.ts", "src/libs/DateUtils.ts", True),
        ("/nowhere/footypes.ts", "/nowhere/footypes.ts", True),
    ]
    df = spark.createDataFrame(rows, "p string, want string, ignored boolean")
    got = df.select(tree_path(F.col("p")), "want", is_ignored_source(tree_path(F.col("p"))), "ignored").collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in got)
