"""Events and model answers."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tracewright.functions import text
from tracewright.operators import gates, responses, review
from tracewright.schemas import SIGNATURE, USER_TAG


def github(**changes):
    payload = {
        "action": "created",
        "comment": {
            "body": f"hey {USER_TAG.upper()} review this full",
            "url": "u/1",
            "user": {"type": "User", "login": "Ann", "email": None, "name": "", "avatar_url": "a"},
        },
        "installation": {"id": 5},
        "repository": {"id": 42},
        "issue": {"number": 7, "url": "i/7", "pull_request": {"url": "p"}},
    }
    for path, value in changes.items():
        *parents, leaf = path.split("__")
        node = payload
        for p in parents:
            node = node[p]
        if value is ...:
            node.pop(leaf)
        else:
            node[leaf] = value
    return json.dumps(payload)


def events(spark, bodies, kind="issue_comment"):
    return spark.createDataFrame([(i, kind, b) for i, b in enumerate(bodies)], "n int, event_type string, body string")


def test_github_reasons_in_order(spark):
    bodies = [
        github(),
        github()[:-1],
        "garbage",
        None,
        github(action="deleted", comment__body="x"),
        github(comment__body="nobody"),
        github(comment__body=...),
        github(installation=...),
        github(installation__id=0),
        github(issue=...),
        github(issue=..., pull_request={"number": 3, "url": "p/3"}),
        github(installation__id="text"),
    ]
    got = [r["reject_reason"] for r in gates.gate_github(events(spark, bodies)).orderBy("n").collect()]
    assert got == [
        None, gates.BAD_JSON, gates.BAD_JSON, gates.BAD_JSON, gates.WRONG_ACTION, f"No {USER_TAG} mention",
        f"No {USER_TAG} mention", gates.NO_INSTALLATION, gates.NO_INSTALLATION, gates.NO_SUBJECT, None, gates.BAD_JSON,
    ]
    pushed = gates.gate_github(events(spark, [github(action="x")], "push")).first()
    assert pushed["reject_reason"] == gates.WRONG_EVENT


def test_github_projection(spark):
    bodies = [
        github(),
        github(issue__pull_request=...),
        github(comment__user__type="BOT"),
        github(comment__user__login="Helper[BOT]"),
        github(issue=..., pull_request={"number": 3, "url": "p/3"}, comment__user__name="Ann B"),
    ]
    got = {r["n"]: r for r in gates.project_github(gates.gate_github(events(spark, bodies))).collect()}
    assert set(got) == {0, 1, 4}
    first = got[0]
    assert (first["repo_id"], first["subject_number"], first["subject_type"]) == ("42", 7, "PullRequest")
    assert (first["name"], first["email"], first["username"]) == ("Ann", "", "Ann")
    assert (first["route"], first["command_name"], first["run_again"]) == ("code_review", "code_review", True)
    assert (got[1]["subject_type"], got[1]["route"]) == ("Issue", "unknown")
    assert (got[4]["subject_number"], got[4]["subject_url"], got[4]["name"]) == (3, "p/3", "Ann B")


def test_bitbucket(spark):
    good = {
        "workspace": {"uuid": "{w}"},
        "repository": {"uuid": "{r}"},
        "pullrequest": {"id": 3, "links": {"html": {"href": "pr"}}},
        "comment": {"id": 9},
        "content": {"raw": f"{USER_TAG} again"},
        "user": {"nickname": "", "uuid": "{u}", "display_name": "D", "links": {"avatar": {"href": "av"}}},
        "links": {"html": {"href": "c"}},
    }
    bad = [
        {**good, "pullrequest": {}},
        {**good, "comment": {}},
        {**good, "workspace": {"uuid": ""}},
        {**good, "content": {"raw": "x"}},
        {**good, "content": {"raw": USER_TAG + SIGNATURE}},
    ]
    gated = gates.gate_bitbucket(events(spark, [json.dumps(x) for x in [good, *bad]] + ["{"]))
    got = [r["reject_reason"] for r in gated.orderBy("n").collect()]
    assert got == [
        None, gates.NO_PULL_REQUEST, gates.NO_COMMENT, "missing fields", f"No {USER_TAG} mention", "own comment", gates.BAD_JSON,
    ]
    row = gates.project_bitbucket(gated.filter("n = 0")).first()
    assert (row["repo_id"], row["username"], row["name"], row["route"]) == ("{r}", "{u}", "D", "code_review")
    assert row["run_again"] is True and row["subject_url"] == "pr"


def test_review_gate(spark):
    requests = spark.createDataFrame(
        [("r", 1, "a", False), ("r", 1, "a", True), ("r", 1, "b", False), ("r", 2, "a", False), ("r", 3, "", False)],
        "repo_id string, pull_request_id bigint, head_sha string, run_again boolean",
    )
    reviews = spark.createDataFrame([("r", 1, "a")], "repo_id string, pull_request_id bigint, last_reviewed_commit_sha string")
    got = gates.review_gate(requests, reviews).select("pull_request_id", "head_sha", "run_again", "skip", "since_sha")
    assert {tuple(r) for r in got.collect()} == {
        (1, "a", False, True, "a"), (1, "a", True, False, None), (1, "b", False, False, "a"), (2, "a", False, False, None),
    }


def test_lost_commits_mean_a_whole_review(spark):
    requests = spark.createDataFrame([("r", 1, "a"), ("r", 2, "b"), ("s", 3, "a"), ("r", 4, None)], "repo_id string, pull_request_id int, since_sha string")
    commits = spark.createDataFrame([("r", "a"), ("r", "a"), ("r", "c")], "repo_id string, sha string")
    got = gates.only_reachable(requests, commits)
    assert got.columns == requests.columns
    assert {r["pull_request_id"]: r["since_sha"] for r in got.collect()} == {1: "a", 2: None, 3: None, 4: None}


def test_answers(spark):
    comment = {"file": "f", "line": 3, "content": "c", "label": "issue"}
    given = {
        "command": ['{"command_name":"blame"}', '{"command_name":"other"}', "{}", "x", None],
        "culprits": [
            '{"issue_id":1,"pull_requests":[{"pull_request_id":2,"reason":"r"}]}',
            '{"issue_id":1,"pull_requests":[{"pull_request_id":2}]}',
            '{"issue_id":1}',
            '{"pull_requests":[]}',
            '{"issue_id":1,"pull_requests":[]}',
        ],
        "summary": ['{"pull_request_description":"d"}', '{"pull_request_description":null}'],
        "review": [
            json.dumps({"pr_number": 1, "code_overview": "o", "comments": [comment]}),
            json.dumps({"pr_number": 1, "code_overview": "o"}),
            json.dumps({"pr_number": 1, "code_overview": "o", "comments": [{**comment, "label": "odd"}]}),
            json.dumps({"pr_number": 1, "comments": []}),
            json.dumps({"pr_number": "one", "code_overview": "o"}),
        ],
        "kept_comments": [json.dumps({"filtered_code_review_comments": [comment]}), "{}"],
    }
    accepted = {
        kind: [
            r["accepted"]
            for r in responses.parse_answers(
                spark.createDataFrame(list(enumerate(texts)), "n int, response string"), kind
            ).orderBy("n").collect()
        ]
        for kind, texts in given.items()
    }
    assert accepted == {
        "command": [True, False, False, False, False],
        "culprits": [True, False, False, False, True],
        "summary": [True, False],
        "review": [True, True, False, False, False],
        "kept_comments": [True, False],
    }


def test_json_lists(spark):
    df = spark.createDataFrame([(1, [5, 6]), (2, []), (3, None)], "n int, x array<bigint>")
    stored = df.select("n", responses.to_json_list(F.col("x")).alias("s"))
    back = stored.select("s", responses.from_json_list(F.col("s"), "bigint").alias("b")).collect()
    assert [tuple(r) for r in back] == [("[5,6]", [5, 6]), (None, []), (None, [])]


def test_findings(spark):
    raw = spark.createDataFrame(
        [
            ("r", 1, "./a.py", 4, [6, 4, 5], "HIGH", "B1", "x"),
            ("r", 1, "./././b.py", 4, None, "Medium", "B2", "y"),
            ("r", 1, "c.py", 9, [9], "LOW", "B3", "z"),
            ("r", 1, "d.py", 9, [9], "odd", "B3", "z"),
        ],
        "repo_id string, pull_request_id bigint, filename string, line_number int, line_range array<int>, "
        "issue_severity string, test_id string, issue_text string",
    )
    rows = review.at_least_medium(review.normalise_findings(raw))
    got = [tuple(r)[2:6] for r in rows.collect()]
    assert got == [("a.py", 6, 4, "high"), ("././b.py", 4, None, "medium")]
    assert review.findings_to_comments(rows).first()["content"] == "HIGH: x (Rule: bandit B1)"


COMMENT_COLUMNS = "repo_id string, pull_request_id bigint, file string, line int, start_line int, content string, label string"


def test_nearby_comments(spark):
    found = "HIGH: Possible hardcoded password: 'x' (Rule: bandit B105)"
    security = spark.createDataFrame([("r", 1, "a", 10, None, found, "security")] * 3, COMMENT_COLUMNS)
    said = "Keep this secret elsewhere"
    rows = [("r", 1, "a", n, None, said, "issue") for n in range(5, 16)] + [("r", 1, "b", 10, None, said, "issue")]
    rows += [("r", 2, "a", 10, None, said, "issue")]
    comments = spark.createDataFrame(rows, COMMENT_COLUMNS)
    kept = review.drop_near_security(comments, security).collect()
    assert {(r["pull_request_id"], r["file"], r["line"]) for r in kept} == {
        (1, "a", 5), (1, "a", 6), (1, "a", 14), (1, "a", 15), (1, "b", 10), (2, "a", 10),
    }
    none = security.filter("line < 0")
    assert review.drop_near_security(comments, none).count() == len(rows)


def test_nearby_comments_on_other_concerns_stay(spark):
    found = [("HIGH: Possible hardcoded password (Rule: bandit B105)", 10), ("MEDIUM: subprocess call with shell=True identified (Rule: bandit B602)", 10)]
    security = spark.createDataFrame([("r", 1, "a", n, None, x, "security") for x, n in found], COMMENT_COLUMNS)
    said = {
        "Name this variable `config`, not `cfg`": True,
        "hard-coded credentials!": False,
        "Passwords belong in the vault": False,
        "shell=True is not needed": False,
        "HIGH and bandit alone say nothing": True,
        "": True,
        "the and for": True,
    }
    rows = [("r", 1, "a", 12, None, x, "issue") for x in said] + [("r", 1, "a", 12, None, None, "issue")]
    kept = review.drop_near_security(spark.createDataFrame(rows, COMMENT_COLUMNS), security)
    assert kept.columns == security.columns
    assert {r["content"] for r in kept.collect()} == {x for x, stays in said.items() if stays} | {None}
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_words_of_a_concern(spark):
    texts = ["LOW: Use of MD5, the hash (Rule: bandit B303)", "Query built from SQL text", "sha-1 and Hashing", None]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select(text.concern_words(F.col("t")).alias("w")).collect()
    assert [sorted(r["w"]) for r in rows] == [["is_hashing"], ["built", "is_sql", "text"], ["is_hashing"], []]


def test_review_rows(spark):
    comments = spark.createDataFrame(
        [
            ("r", 1, "a", 5, 3, "c", "issue"),
            ("r", 1, "a", 5, 5, "c", "security"),
            ("r", 1, "a", 5, 0, "c", "suggestion"),
            ("r", 1, "a", 5, None, "c", "praise"),
            ("r", 1, "zzz", 5, None, "c", "issue"),
        ],
        COMMENT_COLUMNS,
    )
    files = spark.createDataFrame([("r", 1, "a"), ("r", 1, "a")], "repo_id string, pull_request_id bigint, filename string")
    got = review.to_review_rows(review.publishable(comments, files)).orderBy("body").collect()
    assert [(r["body"].split("**")[1], r["start_line"], r["start_side"]) for r in got] == [
        ("issue", 3, "RIGHT"), ("security", None, None), ("suggestion", None, None),
    ]
    text = spark.createDataFrame([([("f", 1, None, "é", "note")],)], "x array<struct<file:string,line:int,start_line:int,content:string,label:string>>")
    shown = text.select(review.comment_json(F.col("x"))).first()[0]
    assert shown == '[{"file":"f","line":1,"start_line":null,"content":"é","label":"note"}]'


def test_words_are_sought_only_where_a_security_comment_is_near(spark):
    rows = [("r", 1, "a.py", line, None, "Move the secret", "issue") for line in range(40)]
    security = spark.createDataFrame([("r", 1, "a.py", 20, None, "HIGH: hardcoded password (Rule: bandit B1)", "security")], COMMENT_COLUMNS)
    kept = review.drop_near_security(spark.createDataFrame(rows, COMMENT_COLUMNS), security)
    assert sorted(r["line"] for r in kept.collect()) == [*range(17), *range(24, 40)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = kept.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scans = [part for part in plan.split("Exchange")[1:] if "regexp_replace" in part]
    assert "regexp_replace" in plan.split("Exchange")[0] and len(scans) == 1  # in the join, and of the security side
