"""Diff operators against hand-made patches and position-based restatements."""

from __future__ import annotations

import re

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_text import QUICK, cases, run

from tracewright.operators import diffs

HUNK = re.compile(r"@@\s*-\d+,?\d*\s*\+(\d+),?\d*\s*@@")
LINES = st.sampled_from(
    ["", "+a", "-b", " c", "d", "+++z", "---", "--", "++", "@@ -1,2 +10,3 @@ f", "@@ -5 +50 @@", "@@ bad", "@@\t-7,1+9@@", "\\ No newline"]
)
PATCH = st.lists(LINES, max_size=14).map("\n".join)


def numbers_of(patch: str) -> list[int | None]:
    """Number of each line: the start of the hunk above plus the live lines between."""
    lines = patch.split("\n")
    starts = {i: int(m[1]) for i, x in enumerate(lines) if x.startswith("@@") and (m := HUNK.search(x))}
    live = [x != "" and not x.startswith(("@@", "+++", "-")) for x in lines]
    hunk = [max((k for k in starts if k < i), default=None) for i in range(len(lines))]
    return [starts[h] + sum(live[h + 1 : i]) if h is not None and live[i] else None for i, h in enumerate(hunk)]


@QUICK
@given(cases(PATCH))
def test_numbers(spark, patches):
    numbers = [numbers_of(p) for p in patches]
    shown = [
        "\n".join(x if n is None else f"{n} {x}" for n, x in zip(ns, p.split("\n"))) for ns, p in zip(numbers, patches)
    ]
    assert run(spark, patches, diffs.numbered_patch) == shown
    added = [
        sorted({n for n, x in zip(ns, p.split("\n")) if n is not None and x.startswith("+")})
        for ns, p in zip(numbers, patches)
    ]
    assert run(spark, patches, diffs.changed_lines) == added


@QUICK
@given(cases(PATCH))
def test_counts(spark, patches):
    got = run(spark, patches, diffs.line_counts)
    want = [
        tuple(sum(x[:1] == m and x[:3] != m * 3 for x in p.splitlines()) for m in "+-") for p in patches
    ]
    assert [tuple(r) for r in got] == want


RAW = st.lists(
    st.sampled_from(
        ["diff --git a/src/x b/src/x", "diff --git a/src/languages/y b/z", "diff --git a/q b/src/w b/v", "diff --git a/bad",
         "diff --git a/e b/", "+1", "", " text", "\ttab "]
    ),
    max_size=12,
)
ENDS = st.sampled_from(["\n", "\r\n", "\r", "\x0c", chr(0x2028)])
DIFF = st.tuples(RAW, ENDS, st.booleans()).map(lambda t: t[1].join(t[0]) + (t[1] if t[2] else ""))
HEADER = re.compile(r"diff --git a/(.*?) b/(.*)")


@QUICK
@given(cases(DIFF))
def test_sections(spark, raws):
    def sections(raw):
        lines = raw.splitlines()
        heads = [i for i, x in enumerate(lines) if HEADER.fullmatch(x)]
        found = {}
        for i, end in zip(heads, [*heads[1:], len(lines)]):
            old, new = HEADER.fullmatch(lines[i]).groups()
            if new:
                found[new] = (old, "\n".join(lines[i + 1 : end]))
        return [(new, old, patch) for new, (old, patch) in found.items()]

    got = run(spark, raws, diffs.file_sections)
    assert [[(s["path"], s["old_path"], s["patch"]) for s in row] for row in got] == [sections(r) for r in raws]


@QUICK
@given(cases(DIFF))
def test_kept_source(spark, raws):
    def kept(raw):
        lines = raw.splitlines(keepends=True)
        owner = [None] * len(lines)
        for i, x in enumerate(lines):
            m = re.match(r"diff --git a/(.*?) b/", x)
            owner[i] = m[1] if m else (owner[i - 1] if i else None)
        good = [o is not None and o.startswith("src/") and not o.startswith("src/languages") for o in owner]
        return "".join(x for x, g in zip(lines, good) if g).strip()

    assert run(spark, raws, diffs.keep_source_sections) == [kept(r) for r in raws]


def test_status(spark):
    patches = ["new file mode 100644\n@@ x", "deleted file mode 1\n--- a", "--- a\n@@ -1 +1 @@\nnew file mode", ""]
    assert run(spark, patches, diffs.patch_status) == ["added", "removed", "modified", "modified"]


def test_review_text(spark):
    raw = (
        "noise\ndiff --git a/a.py b/a.py\nnew file mode 1\n--- /dev/null\n+++ b/a.py\n@@ -0,0 +1,2 @@\n+x\n+y\n"
        "diff --git a/b b/b\ndiff --git a/c b/d\n@@ -3 +4 @@\n q\n-r\n"
    )
    assert run(spark, [raw], diffs.review_text) == [
        "## File: a.py\nStatus: added\nChanges: +2 -0\n\nnew file mode 1\n--- /dev/null\n+++ b/a.py\n@@ -0,0 +1,2 @@\n"
        "1 +x\n2 +y\n\n## File: d\nStatus: modified\nChanges: +0 -1\n\n@@ -3 +4 @@\n4  q\n-r"
    ]
    assert run(spark, [raw], diffs.reviewed_files) == [["a.py", "d"]]


def test_stats_with_patches(spark):
    path = "struct<path: string>"
    stats = spark.createDataFrame(
        [
            (1, None, 3, None, ("n",), ("o",)),
            (1, "removed", None, 2, None, ("gone",)),
            (1, "added", 1, 0, ("",), None),
            (1, "renamed", 1, 1, ("",), ("o2",)),
        ],
        f"pr int, status string, lines_added int, lines_removed int, new {path}, old {path}",
    )
    patches = spark.createDataFrame([(1, "n", "P"), (2, "gone", "Q")], "pr int, path string, patch string")
    got = diffs.with_patches(stats, patches, ["pr"]).orderBy("filename").collect()
    assert [tuple(r)[1:] for r in got] == [
        ("gone", "removed", 0, 2, None),
        ("n", "modified", 3, 0, "P"),
        ("o2", "renamed", 1, 1, None),
    ]


def test_no_shuffle(spark):
    """Reading diffs stays within rows."""
    raw = spark.createDataFrame([("r", 1, "x")], "repo_id string, pull_request_id int, raw_diff string")
    files = diffs.describe_patches(diffs.split_diffs(raw))
    rows = diffs.changed_line_rows(files, ["path"])
    plans = [rows, raw.select(diffs.review_text(F.col("raw_diff")))]
    assert all("Exchange" not in p._jdf.queryExecution().executedPlan().toString() for p in plans)
