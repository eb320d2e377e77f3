"""Text expressions against Python's own behaviour and hand-made cases. Each test is one Spark job."""

from __future__ import annotations

import datetime as dt
from email.utils import format_datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.functions import core, dates, numbers, text
from tracewright.schemas import SIGNATURE, USER_TAG

SPACED = st.text(alphabet="ab \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0" + chr(0x2028) + chr(0x2003) + "é", max_size=12)
ANY = st.text(max_size=12)


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def run(spark, values, expression, kind="string"):
    return [r[0] for r in column(spark, values, kind).select(expression(F.col("x"))).collect()]


def cases(strategy, size=150):
    """A fixed-size list of examples, so that a property costs one job."""
    return st.lists(strategy, min_size=size, max_size=size)


QUICK = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


@QUICK
@given(cases(SPACED))
def test_lines_words_and_strip_follow_python(spark, values):
    assert run(spark, values, core.split_lines) == [v.splitlines() for v in values]
    assert run(spark, values, core.words) == [v.split() for v in values]
    assert run(spark, values, core.strip) == [v.strip() for v in values]


@QUICK
@given(cases(st.one_of(SPACED, ANY, st.text(alphabet="'\"\\a\n", max_size=6))))
def test_repr_follows_python(spark, values):
    # characters newer than the JVM's tables are left out
    known = [v for v in values if all(ord(c) < 0x2000 for c in v)]
    assert run(spark, known, text.py_repr) == [repr(v) for v in known]


@QUICK
@given(cases(st.floats(-1e6, 1e6), 300))
def test_fixed_rounds_like_python(spark, values):
    values += [0.125, 0.375, 2.5, 0.285, -0.001]
    assert run(spark, values, lambda c: core.fixed(c, 2), "double") == [f"{v:.2f}" for v in values]
    assert run(spark, values, lambda c: core.fixed(c, 0), "double") == [f"{v:.0f}" for v in values]


def test_test_steps(spark):
    body = "x\r\n### TESTS\r\n- [ ] open\r\n- [X]  close\r\n<!-- a\r\nb -->\r\n\r\n\r\n\r\nend\r### PR author checklist ### Tests"
    got = run(spark, [body, "### Tests only", ""], text.test_steps)
    assert got == ["### TESTS\nopen\nclose\n\nend", "", ""]


def test_explanation(spark):
    body = "### explanation of CHANGE\n a <!-- x --> b\n\n\n\nc \n### Fixed Issues ### Fixed Issues"
    assert run(spark, [body, "### Explanation of Change"], text.explanation) == ["a  b\n\nc", ""]


def test_reproduction_steps(spark):
    good = "intro ##Action Performed: 1\n## Expected  Result: ok\n##\nactual result:\tbad \n## Workaround: none"
    missing = "## Action Performed: 1 ## Actual Result: x ## Workaround:"
    got = run(spark, [good, missing], text.reproduction_steps)
    assert got == ["##Action Performed: 1\n## Expected  Result: ok\n##\nactual result:\tbad", ""]


def test_linked_issue_ids(spark):
    bodies = [
        "$ #12 and $#7, $ https://h/o/a.b+c/issues/9 $ [#4](https://h/o/a.b+c/issues/5) $ #12",
        "$ https://h/o/aXb+c/issues/9",
        "$ [#4](https://h/other/issues/5)",
        "#5 without a sign",
        "$ #99999999999999999999",
    ]
    assert run(spark, bodies, lambda c: text.linked_issue_ids(c, "a.b+c")) == [[12, 7, 9, 4, 12], None, None, None, [None]]


def test_merge_commits(spark):
    messages = ["Merge pull request #12 from x", 'Revert "Merge pull request #3"', "x\nMerge pull request #4", "Merge pull request #"]
    assert run(spark, messages, text.merged_pull_request) == [12, None, None, None]


def test_mention_context(spark):
    many = " ".join(f"w{i}" for i in range(60))
    middle = " ".join([*(f"a{i}" for i in range(15)), f"({USER_TAG.upper()}),", *(f"b{i}" for i in range(30))])
    got = run(spark, [f"{USER_TAG} {many}", middle, f"{many} {USER_TAG}", many, f"a\xa0{USER_TAG}"], text.mention_context)
    words = [g.split(" ") for g in got]
    assert [len(w) for w in words] == [20, 30, 11, 50, 2]
    assert words[0][0] == USER_TAG and words[1][0] == "a5" and words[1][-1] == "b18" and words[2][0] == "w50"


def test_rerun_and_commands(spark):
    assert run(spark, ["Do it AGAIN", "full, review", "a\nfull", ""], text.wants_rerun) == [True, False, True, False]
    rows = [
        (f"{USER_TAG} who is the culprit", "Issue", "blame"),
        (f"{USER_TAG} please review", "PullRequest", "code_review"),
        (f"{USER_TAG} review the cause", "PullRequest", "code_review"),
        (f"{USER_TAG} review the cause", "Issue", "blame"),
        (f"{USER_TAG} hello", "Issue", "unknown"),
        ("x " * 60 + "review", "Issue", "unknown"),
    ]
    df = spark.createDataFrame(rows, "body string, subject string, want string")
    got = df.select(text.classify_command(F.col("body"), F.col("subject")), "want").collect()
    assert all(a == b for a, b in got)


def test_quotes_and_names(spark):
    assert run(spark, [" a\nb\r\n\nc \n", ""], text.blockquote) == ["> a\n> b\n> \n> c", ""]
    names = ["a/b c", "..x..", ".hid", "", "é" * 3, "y" * 120]
    assert run(spark, names, text.safe_path_name) == ["a-b-c", "-x-", "hid", None, "---", "y" * 100]


def test_culprit_comment(spark):
    culprits = "array<struct<pull_request_id: bigint, reason: string>>"
    got = run(spark, [[(1, "a"), (2, "b"), (3, "c")], [(4, "d")], []], lambda c: text.culprit_comment(c, "T"), culprits)
    assert got == [
        "### T\n- #1: a\n- #2: b\n\n#### If not above, check these\n- #3: c\n",
        "### T\n- #4: d\n",
        "",
    ]


def test_review_body(spark):
    df = spark.createDataFrame([("o", "0123456789"), ("o", ""), ("o", None)], "o string, sha string")
    got = [r[0] for r in df.select(text.review_body(F.col("o"), F.col("sha"))).collect()]
    assert got[0].startswith("**This review covers only the changes made since the last review (commit 0123456)")
    assert got[0].endswith("Use `full review` to review entire PR\no" + SIGNATURE) and got[1:] == ["o" + SIGNATURE] * 2


def test_candidate_card_defaults(spark):
    df = spark.createDataFrame(
        [(1, "t", "  ", [], "", 0.125, None)],
        "i bigint, t string, test string, f array<string>, s string, score double, e string",
    )
    card = df.select(text.candidate_card(*[F.col(c) for c in df.columns])).first()[0]
    assert card == (
        "PR id #1\n\nTitle: t\n\nTest Steps: \n\nFiles Changed: No files listed.\n\n"
        "Code diff summary: No code diff summary provided.\n\nScore: 0.12\n\nExplanation: No explanation provided."
    )


def test_weeks_follow_strftime(spark):
    days = [dt.datetime(y, 1, 1) + dt.timedelta(days=n) for y in (2016, 2017, 2022, 2023, 2024) for n in (*range(16), *range(350, 366))]
    got = run(spark, days, dates.sunday_week, "timestamp_ntz")
    assert got == [d.strftime("%Y-%U") for d in days]


def test_time_texts_follow_python(spark):
    times = [dt.datetime(2023, 10, 25, 19, 17, 59), dt.datetime(2024, 2, 29, 0, 0, 1, 1200), dt.datetime(1999, 12, 31)]
    utc = [t.replace(tzinfo=dt.UTC) for t in times]
    assert run(spark, times, dates.iso8601, "timestamp_ntz") == [t.isoformat().replace("+00:00", "Z") for t in utc]
    assert run(spark, times, dates.rfc1123, "timestamp_ntz") == [format_datetime(t) for t in utc]
    assert run(spark, times[:1], lambda c: dates.month_label(c), "timestamp_ntz") == ["Oct-2023"]


def test_effort_texts(spark):
    assert run(spark, [9.96, 10.4, 5.25], numbers.hours_text, "double") == ["10.0h", "10h", "5.2h"]
    assert run(spark, [999.9, 1000.0, 12345.0], numbers.usd_text, "double") == ["999", "1.0K", "12.3K"]


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = [r[0] for r in df.select(numbers.cosine(a, b, numbers.norm(a), numbers.norm(b))).collect()]
    assert abs(got[0] - 0.5**0.5) < 1e-12 and got[1:] == [None, None]
