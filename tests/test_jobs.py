"""Sources, streams and whole jobs."""

from __future__ import annotations

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewright.operators.commits import commits_ahead, merged_numbers
from tracewright.operators.delivery import describe
from tracewright.operators.gates import gate_bitbucket, gate_github, project_bitbucket, project_github
from tracewright.operators.ordering import keep_first
from tracewright.operators.responses import parse_answers
from tracewright.plans import deploys, ingest, ranking, reviewing, source_index
from tracewright.schemas import DIFFSTAT_PAGE, SIGNATURE, USER_TAG
from tracewright.session import shared_dir
from tracewright.sources import files
from tracewright.streaming.ledger import append_comments, comment_ledger, ledger_tables


def test_source_tree(spark, tmp_path):
    root = tmp_path / "app" / "src"
    (root / "libs").mkdir(parents=True)
    (root / "a b+c%20.tsx").write_bytes(b"x\xff y\r\nz")
    (root / "libs" / "d.ts").write_text("import a\nfunction go(x) {}\n")
    (root / "types.ts").write_text("no")
    rows = {r["path"]: r["content"] for r in files.read_source_tree(spark, str(tmp_path)).collect()}
    assert rows["src/a b+c%20.tsx"] == "x y\r\nz" and set(rows) == {"src/a b+c%20.tsx", "src/libs/d.ts", "src/types.ts"}
    index = source_index.index_sources(files.read_source_tree(spark, str(tmp_path)))
    files.write_documents(index, str(tmp_path / "out"))
    stored = {r["path"]: r["lines"] for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert stored == {"src/libs/d.ts": ["function go(...)"], "src/a b+c%20.tsx": []}
    shown = {r["path"]: (r["lines"], r["summary"]) for r in source_index.preview(index).collect()}
    assert shown["src/libs/d.ts"] == (1, "['function go(...)']")


def test_pages_and_tables(spark, tmp_path):
    page = lambda *paths: json.dumps({"values": [{"new": {"path": p}} for p in paths], "next": "n"})
    df = spark.createDataFrame([(1, page("a", "b")), (1, page("c")), (2, page()), (3, "{}")], "pr int, body string")
    got, rejected = files.page_values(df, DIFFSTAT_PAGE)
    assert rejected.count() == 1  # the one that is no list
    assert sorted((r["pr"], r["new"]["path"]) for r in got.collect()) == [(1, "a"), (1, "b"), (1, "c")]
    rows = spark.createDataFrame([("r", 1), ("{u}", 2)], "repo_id string, id bigint")
    rows.write.partitionBy("repo_id").parquet(str(tmp_path / "t.parquet"))
    table = files.read_table(spark, str(tmp_path), "t")
    one = files.tenant_scan(table, "{u}", ["id"])
    assert [r["id"] for r in one.collect()] == [2]
    assert "PartitionFilters: [isnotnull(repo_id" in one._jdf.queryExecution().executedPlan().toString()
    asked = spark.createDataFrame([(1,), (7,)], "id bigint")
    assert {tuple(r) for r in files.lookup(asked, table, ["id"]).collect()} == {(1, "r"), (7, None)}
    path = files.save_snapshot(rows, str(tmp_path / "snap"), 3)
    assert spark.read.parquet(path).count() == 2 and path.endswith("version=3")
    assert files.read_or_empty(spark, str(tmp_path / "none"), rows.schema).count() == 0


def test_shared_dir_is_taken_from_the_session(spark):
    assert shared_dir(spark) == shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


CSV = {
    "blockers": """StagingDeployCash Issue,StagingDeployCash Issue Number,StagingDeployCash GitHub URL,StagingDeployCash Created At
"a, ""b""
c",1,u1,2024-01-06T10:00:00Z
b,1,u1,2024-01-06T10:00:00Z
c,2,u2,2024-01-07T10:00:00Z
d,3,,2024-02-07T10:00:00Z
""",
    "fixes": "id,date\n5,2024-01-02T00:00:00Z\n5,2024-03-02T00:00:00Z\n6,2024-02-02T00:00:00Z\n",
    "merged": "id,merged_at\n1,2024-01-02T00:00:00Z\n2,2024-01-03T06:00:00Z\n9,2024-04-03T00:00:00Z\n",
}


def test_deploy_report(spark, tmp_path):
    paths = []
    for name, text in CSV.items():
        (tmp_path / f"{name}.csv").write_text(text)
        paths.append(str(tmp_path / f"{name}.csv"))
    report = deploys.deploy_report(spark, *paths)
    rows = lambda name, *order: [tuple(r) for r in report[name].orderBy(*order).collect()]
    assert [r[0] for r in rows("blockers_per_deploy", "deploy_number")] == [1, 2]
    assert rows("blockers_per_week", "week") == [("2024-00", 2), ("2024-01", 1), ("2024-05", 1)]
    assert rows("deploys_per_month", "month") == [(2024, 1, 2), (2024, 2, 1)]
    assert [r[:4] for r in rows("blockers_per_month", "month")] == [(2024, 1, "Jan-2024", 3), (2024, 2, "Feb-2024", 1)]
    assert {r["measure"]: (r["mean"], r["median"]) for r in report["averages"].collect()} == {
        "blockers per deploy": (1.5, None), "deploys per month": (1.5, None),
        "blockers per month": (2.0, 2.0), "blockers per week": (pytest.approx(4 / 3), 1.0),
    }
    assert [r[1:4] for r in rows("merged_and_fixes", "month")] == [("Jan-2024", 2, 1), ("Feb-2024", 0, 1), ("Apr-2024", 1, 0)]
    assert {r["column"]: r["count"] for r in report["fixes_described"].collect()} == {"id": 2, "date": 2}


def test_describe_follows_pandas(spark):
    frame = pd.DataFrame({"id": [5, 1, 9, 9, 2, 7], "date": pd.to_datetime([f"2024-01-0{n} 03:00" for n in (1, 5, 2, 9, 4, 4)])})
    got = {r["column"]: r for r in describe(spark.createDataFrame(frame)).collect()}
    want = frame.describe()
    for stat in ("count", "mean", "std", "min", "25%", "50%", "75%", "max"):
        assert got["id"][stat] == pytest.approx(want["id"][stat])
        if stat not in ("count", "std"):
            assert got["date"][stat] == pytest.approx(want["date"][stat].timestamp())
    assert got["date"]["std"] is None


def comments(spark, rows):
    return spark.createDataFrame(
        [(t, n, who, "blame", f"c/{n}", "s", "hi", who.upper(), "", "") for t, n, who in rows],
        "at timestamp, n bigint, username string, command_name string, comment_url string, subject_url string, "
        "comment_text string, name string, email string, avatar_url string",
    )


def test_ledger_batches_and_replay(spark, tmp_path):
    when = pd.Timestamp("2024-01-01").to_pydatetime()
    root = str(tmp_path / "ledger")
    first = comments(spark, [(when, 1, "bob"), (when, 2, "ann"), (when, 3, "bob")])
    second = comments(spark, [(when, 4, "cy"), (when, 5, "ann")])
    for batch, rows in ((0, first), (1, second), (1, second), (0, first)):
        append_comments(rows, batch, root, ["at", "n"])
    append_comments(second.limit(0), 2, root, ["at", "n"])
    append_comments(comments(spark, [(when, 6, "dee")]), 3, root, ["at", "n"])
    users, logs = (rows.orderBy("id").collect() for rows in ledger_tables(spark, root))
    assert [(r["id"], r["username"], r["name"]) for r in users] == [(1, "bob", "BOB"), (2, "ann", "ANN"), (3, "cy", "CY"), (4, "dee", "DEE")]
    assert [(r["id"], r["user_id"], r["comment_url"]) for r in logs] == [
        (1, 1, "c/1"), (2, 2, "c/2"), (3, 1, "c/3"), (4, 3, "c/4"), (5, 2, "c/5"), (6, 4, "c/6"),
    ]
    assert logs[0]["output"] == "default output" and logs[0]["issue_or_pull_request_url"] == "s"


def payload(n, login):
    return json.dumps({
        "action": "created", "installation": {"id": 1}, "repository": {"id": 3}, "issue": {"number": n},
        "comment": {"body": f"{USER_TAG} cause?", "url": f"c/{n}", "user": {"login": login}},
    })


def drop_in(folder, name, rows):
    folder.mkdir(exist_ok=True)
    pd.DataFrame(rows).to_parquet(folder / name, coerce_timestamps="us")


def test_comment_stream_restarts(spark, tmp_path):
    inbox, root = tmp_path / "in", str(tmp_path / "state")
    schema = "ts timestamp, n bigint, event_type string, body string"
    row = lambda n, login, body=None: {
        "ts": pd.Timestamp(2024, 1, n, tz="UTC"), "n": n, "event_type": "issue_comment", "body": body or payload(n, login)
    }
    drop_in(inbox, "a.parquet", [row(1, "ann"), row(2, "x[bot]"), row(3, "ann", "{broken")])

    def go():
        events = spark.readStream.schema(schema).parquet(str(inbox))
        comment_ledger(project_github(gate_github(events)), root, ["ts", "n"]).awaitTermination()

    go()
    go()
    drop_in(inbox, "b.parquet", [row(4, "bob"), row(5, "ann")])
    go()
    logs = ledger_tables(spark, root)[1].orderBy("id").collect()
    assert [(r["id"], r["user_id"], r["comment_url"], r["command_name"]) for r in logs] == [
        (1, 1, "c/1", "blame"), (2, 2, "c/4", "blame"), (3, 1, "c/5", "blame"),
    ]


def test_bitbucket_stream(spark, tmp_path):
    body = json.dumps({
        "workspace": {"uuid": "{w}"}, "repository": {"uuid": "{r}"}, "pullrequest": {"id": 3}, "comment": {"id": 9},
        "content": {"raw": f"{USER_TAG} full"}, "user": {"nickname": "nick"}, "links": {"html": {"href": "c"}},
    })
    drop_in(tmp_path / "in", "a.parquet", [{"ts": pd.Timestamp(2024, 1, n, tz="UTC"), "n": n, "body": b} for n, b in ((1, body), (2, "{"))])
    events = spark.readStream.schema("ts timestamp, n bigint, body string").parquet(str(tmp_path / "in"))
    root = str(tmp_path / "state")
    comment_ledger(project_bitbucket(gate_bitbucket(events)), root, ["ts", "n"]).awaitTermination()
    users, logs = ledger_tables(spark, root)
    row = logs.first()
    assert (row["id"], row["user_id"], row["command_name"], row["comment_url"]) == (1, 1, "code_review", "c")
    assert users.first()["username"] == "nick"


def test_first_row_of_many_files_wins(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    for n in range(6):
        lines = [f"{i},2024-0{n + 1}-01T00:00:00Z" for i in range(n, 200 * (n + 1))]
        (folder / f"part-{n}.csv").write_text("id,merged_at\n" + "\n".join(lines) + "\n")
    rows = keep_first(files.read_merged(spark, str(folder)), ["id"], "row")
    got = {r["id"]: r["date"].month for r in rows.collect()}
    assert got == {i: i // 200 + 1 for i in range(1200)}


def test_ingest(spark):
    commits = spark.createDataFrame(
        [("r", 1, "staging", "1", "Merge pull request #7 from a"), ("r", 1, "staging", "2", "Merge pull request #8 from b"),
         ("r", 1, "staging", "3", 'Revert "Merge pull request #9"'), ("r", 1, "staging", "4", "Merge pull request #7 again"),
         ("r", 4, "staging", "1", "Merge pull request #7 from a"), ("r", 4, "staging", "5", "Merge pull request #99 unknown"),
         ("r", None, "production", "2", "x"), ("s", None, "production", "1", "x")],
        "repo_id string, issue_id bigint, branch string, sha string, message string",
    )
    assert sorted(r["pull_request_id"] for r in merged_numbers(commits_ahead(commits)).collect()) == [7, 99]
    bodies = spark.createDataFrame(
        [("r", 7, "T", "### Explanation of Change x ### Fixed Issues\n$ #3", ["a'b"], "S"), ("r", 8, "U", None, [], "S")],
        "repo_id string, id bigint, title string, body string, files array<string>, code_diff_summary string",
    )
    pulls = spark.createDataFrame([], "repo_id string, id bigint")
    links = spark.createDataFrame([(9, 7, "r", 0.1)], "issue_id bigint, pull_request_id bigint, repo_id string, score double")
    now = F.lit("2025-01-01").cast("timestamp")
    job = ingest.ingest_staged(commits, bodies, pulls, links, "repo", now)
    row = job.fresh.first()
    assert (row["id"], row["explanation"], row["linked_issue_ids"]) == (7, "x", [3])
    assert row["embedding_text"] == "Title: T\n Tests: \n Explanation: x\n Files changed: [\"a'b\"]\n Code diff summary: S"
    assert sorted(tuple(r) for r in job.links.collect()) == [(1, 7, "r", 0.0), (4, 7, "r", 0.0)]


def test_ranking(spark):
    pulls = spark.createDataFrame(
        [("r", i, "CP STAGING fix" if i == 3 else "t", None, "", ["f"], None) for i in range(40)],
        "repo_id string, id bigint, title string, test string, explanation string, files array<string>, code_diff_summary string",
    )
    vectors = spark.createDataFrame([("r", i, [1.0, i / 40]) for i in range(39)] + [("r", 39, [0.0, 0.0])], "repo_id string, pull_request_id bigint, embedding array<double>")
    issues = spark.createDataFrame([("r", 2, True)], "repo_id string, id bigint, is_processed boolean")
    issue_vectors = spark.createDataFrame([("r", i, [1.0, 0.0]) for i in (1, 2, 3)], "repo_id string, issue_id bigint, embedding array<double>")
    requests = spark.createDataFrame([("r", 1, ["DeployBlockerCash"]), ("r", 2, ["DeployBlockerCash"]), ("r", 3, ["x"])], "repo_id string, issue_id bigint, labels array<string>")
    links = spark.createDataFrame([(i, p, "r", 0.0) for i in (1, 2, 3) for p in range(40)], "issue_id bigint, pull_request_id bigint, repo_id string, score double")
    job = ranking.rank_candidates(requests, issues, issue_vectors, pulls, vectors, links)
    ranked = job.ranked.orderBy("rank").collect()
    assert [(r["issue_id"], r["pull_request_id"]) for r in ranked] == [(1, p) for p in range(26) if p != 3]
    second = ranking.rank_candidates(requests, issues, issue_vectors, pulls, vectors, links, page=1)
    assert [r["pull_request_id"] for r in second.ranked.orderBy("rank").collect()] == list(range(26, 39))
    assert ranking.rank_candidates(requests, issues, issue_vectors, pulls, vectors, links, page=9).ranked.count() == 0
    block = job.blocks.first()
    assert block["candidates"] == 25 and block["block"].startswith("PR id #0\n\nTitle: t\n\nTest Steps: No test")
    stored = {(r["issue_id"], r["pull_request_id"]): r["score"] for r in ranking.store_scores(links, job).collect()}
    assert stored[(1, 0)] == 1.0 and stored[(2, 0)] == 0.0 and stored[(1, 39)] is None
    answers = spark.createDataFrame(
        [("r", '{"issue_id": 2, "pull_requests": [{"pull_request_id": 5, "reason": "why"}]}'), ("r", '{"issue_id": 1, "pull_requests": []}')],
        "repo_id string, response string",
    )
    read = parse_answers(answers, "culprits")
    assert [tuple(r)[1:] for r in ranking.publish_culprits(read).collect()] == [(2, "### Possible culprit PRs for this issue\n- #5: why\n")]
    pages = read.select("repo_id", (F.lit(1) - F.size("answer.pull_requests")).alias("page"), "answer", "accepted")
    more = pages.withColumn("page", F.lit(7))
    joined = {r["answer"]["issue_id"]: len(r["answer"]["pull_requests"]) for r in ranking.join_pages(pages.unionByName(more)).collect()}
    assert joined == {1: 0, 2: 2}
    kept = issues.withColumn("culprit_pull_requests", F.lit(None).cast("array<struct<pull_request_id: bigint, reason: string>>"))
    done = ranking.store_culprits(kept, read).first()
    assert done["is_processed"] and done["culprit_pull_requests"][0]["pull_request_id"] == 5


def test_review(spark):
    raw = "diff --git a/a.py b/a.py\n@@ -1 +1,2 @@\n+x\n+y\ndiff --git a/b.log b/b.log\n@@ -1 +1 @@\n+z\n"
    diffs = spark.createDataFrame([("r", 1, raw)], "repo_id string, pull_request_id bigint, raw_diff string")
    patterns = spark.createDataFrame([("r", 1, "*.log")], "repo_id string, ord int, pattern string")
    ready = reviewing.review_input(diffs, patterns)
    assert [r["filename"] for r in ready.sections.collect()] == ["a.py"]
    assert sorted((r["file"], r["line"]) for r in ready.changed.collect()) == [("a.py", 1), ("a.py", 2)]
    findings = spark.createDataFrame(
        [("r", 1, "./a.py", 2, [1, 2], "HIGH", "B1", "bad"), ("r", 1, "./a.py", 7, None, "HIGH", "B1", "unchanged"), ("r", 1, "a.js", 2, None, "HIGH", "B1", "js")],
        "repo_id string, pull_request_id bigint, filename string, line_number int, line_range array<int>, issue_severity string, test_id string, issue_text string",
    )
    said = spark.createDataFrame(
        [("r", 1, "a.py", 5, None, "a bad call", "issue"), ("r", 1, "a.py", 6, None, "a bad call", "issue"), ("r", 1, "gone", 6, None, "x", "issue")],
        "repo_id string, pull_request_id bigint, file string, line int, start_line int, content string, label string",
    )
    overview = spark.createDataFrame([("r", 1, "ov", None)], "repo_id string, pull_request_id bigint, code_overview string, since_sha string")
    done = reviewing.assemble_review(findings, ready.changed, said, ready.files, overview)
    rows = done.rows.orderBy("source", "line").collect()
    assert [(r["source"], r["path"], r["line"], r["start_line"]) for r in rows] == [(0, "a.py", 2, 1), (1, "a.py", 6, None)]
    assert rows[0]["body"] == "**security**: HIGH: bad (Rule: bandit B1)" + SIGNATURE
    assert done.bodies.first()["body"] == "ov" + SIGNATURE
