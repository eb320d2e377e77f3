"""Files and other hosts' answers as sources: tables written out as the files they come from, and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import gates, responses
from tracewright.plans.deploys import deploy_report as report
from tracewright.plans.source_index import index_sources
from tracewright.schemas import COMMENT_LABELS, SIGNATURE, USER_TAG
from tracewright.session import scratch_path
from tracewright.sources import files
from tracewright.workloads import feeds
from tracewright.workloads.base import ctes, query, t
from tracewright.workloads.deploys import DEPLOYS, MONTHS, WEEKS
from tracewright.workloads.feeds import BLOCKERS, LINKS, PULLS
from tracewright.workloads.sources import CLEANED, CODE, INDEX, _files

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _exports(spark: SparkSession, d: str) -> list[str]:
    """The three report files: blockers with free text over several lines, fixes, merged changes."""
    root = scratch_path(spark, "exports")
    orders = t(spark, d, "orders")
    made = F.date_format("o_orderdate", ISO)
    blockers = feeds.blockers(spark, d).select(
        F.concat(F.lit('He said "stop",\nthen\r\n\n'), F.col("deploy_url"), F.lit('"')).alias("StagingDeployCash Issue"),
        F.col("deploy_number").alias("StagingDeployCash Issue Number"),
        F.col("deploy_url").alias("StagingDeployCash GitHub URL"),
        F.date_format("created_at", ISO).alias("StagingDeployCash Created At"),
    )
    urgent = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")
    fixes = orders.filter(urgent).select(F.col("o_orderkey").alias("id"), made.alias("date"))
    merged = orders.select(F.col("o_orderkey").alias("id"), made.alias("merged_at"))
    for name, rows in (("blockers", blockers), ("fixes", fixes), ("merged", merged)):
        rows.write.csv(f"{root}/{name}", header=True, quote='"', escape='"', quoteAll=name == "blockers")
    return [f"{root}/{name}" for name in ("blockers", "fixes", "merged")]


@query(
    ctes(BLOCKERS, MONTHS, WEEKS, DEPLOYS)
    + """, merged AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders GROUP BY ALL),
fixes AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders
  WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' GROUP BY ALL),
fixed AS (SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')
SELECT 'blockers_per_deploy' AS frame, deploy_url AS label, count(*)::DOUBLE AS a, deploy_number::DOUBLE AS b
  FROM blockers GROUP BY deploy_number, deploy_url, created_at
UNION ALL SELECT 'blockers_per_month', strftime(make_date(year, month, 1), '%b-%Y'), blockers, round(blockers * (5.0::DOUBLE / 60), 6) FROM monthly
UNION ALL SELECT 'blockers_per_week', week, blockers, NULL FROM weekly
UNION ALL SELECT 'deploys_per_month', strftime(make_date(year, month, 1), '%b-%Y'), deploys, NULL FROM deploys
UNION ALL SELECT 'averages', 'blockers per month', round(avg(blockers), 6), median(blockers) FROM monthly
UNION ALL SELECT 'averages', 'blockers per week', round(avg(blockers), 6), median(blockers) FROM weekly
UNION ALL SELECT 'averages', 'deploys per month', round(avg(deploys), 6), NULL FROM deploys
UNION ALL SELECT 'averages', 'blockers per deploy', round(avg(n), 6), NULL FROM (SELECT count(*) AS n FROM blockers GROUP BY deploy_number, deploy_url, created_at)
UNION ALL SELECT 'merged_described', 'id', count(*), quantile_cont(o_orderkey, 0.75) FROM orders
UNION ALL SELECT 'fixes_described', 'id', count(*), quantile_cont(id, 0.75) FROM fixed
UNION ALL SELECT 'merged_and_fixes', strftime(coalesce(m.month, f.month), '%b-%Y'), coalesce(m.n, 0), coalesce(f.n, 0)
  FROM merged m FULL JOIN fixes f ON f.month = m.month WHERE NOT (year(coalesce(m.month, f.month)) = 2025 AND month(coalesce(m.month, f.month)) = 6)"""
)
def deploy_report(spark: SparkSession, d: str) -> DataFrame:
    """The whole report from its exported files, one line for each number in it."""
    frames = report(spark, *_exports(spark, d))
    label = F.date_format(F.make_date("year", "month", F.lit(1)), "MMM-yyyy")
    none = F.lit(None).cast("double")
    lines = {
        "blockers_per_deploy": ("deploy_url", "blockers", "deploy_number"),
        "blockers_per_month": ("label", "blockers", F.round("hours", 6)),
        "blockers_per_week": ("week", "blockers", none),
        "deploys_per_month": (label, "deploys", none),
        "averages": ("measure", F.round("mean", 6), "median"),
        "merged_described": ("column", "count", "75%"),
        "fixes_described": ("column", "count", "75%"),
        "merged_and_fixes": ("label", "merged", "fixes"),
    }
    parts = []
    for name, columns in lines.items():
        named = [F.col(f"`{c}`") if isinstance(c, str) else c for c in columns]
        rows = frames[name].filter("column = 'id'") if name.endswith("described") else frames[name]
        parts.append(rows.select(F.lit(name).alias("frame"), named[0].alias("label"), named[1].cast("double").alias("a"), named[2].cast("double").alias("b")))
    return reduce(DataFrame.unionByName, parts)


@query(
    ctes(CODE, CLEANED, INDEX)
    + "SELECT path, len(lines)::INTEGER AS size, array_to_string(lines, chr(10)) AS lines FROM index_lines"
)
def source_tree_index(spark: SparkSession, d: str) -> DataFrame:
    """A source tree of one file for each page, read, indexed and stored as JSON documents; what the documents hold."""
    root = scratch_path(spark, "tree")
    files.write_source_tree(_files(spark, d), root)
    found = files.read_source_tree(spark, f"{root}/src")
    files.write_documents(index_sources(found.withColumn("path", files.written_path(F.col("path")))), f"{root}/documents")
    stored = spark.read.schema("path string, lines array<string>").json(f"{root}/documents")
    return stored.select("path", F.size("lines").alias("size"), F.array_join("lines", "\n").alias("lines"))


@query(
    f"""SELECT conv_id, turn, '{{r' || conv_id % 3 || '}}' AS repo_id, conv_id + 1 AS subject_number, 'https://pr.test/' || conv_id AS subject_url,
  text || ' {USER_TAG}' || CASE WHEN turn = 0 THEN ' again' ELSE '' END AS comment_text, 'https://c.test/' || turn AS comment_url,
  CASE WHEN role = 'user' THEN 'nick' || conv_id ELSE '{{u' || conv_id || '}}' END AS username,
  CASE WHEN turn % 2 = 0 THEN 'Name ' || conv_id WHEN role = 'user' THEN 'nick' || conv_id ELSE '' END AS name,
  'code_review' AS command_name, 'code_review' AS route
FROM conversations WHERE turn NOT IN (1, 3) AND role <> 'system'"""
)
def bitbucket_projection(spark: SparkSession, d: str) -> DataFrame:
    """Admitted comments of the other host as the same flat rows."""
    turn, number = F.col("turn"), F.col("conv_id").cast("string")
    said = F.concat("text", F.lit(f" {USER_TAG}"), F.when(turn == 0, " again").otherwise(""), F.when(turn == 1, SIGNATURE).otherwise(""))
    link = lambda url: F.struct(F.struct(url.alias("href")).alias("html"))
    user = F.struct(
        F.when(F.col("role") == "user", F.concat(F.lit("nick"), number)).alias("nickname"),
        F.concat(F.lit("{u"), number, F.lit("}")).alias("uuid"),
        F.when(turn % 2 == 0, F.concat(F.lit("Name "), number)).alias("display_name"),
    )
    payload = F.struct(
        F.struct(F.lit("{w}").alias("uuid")).alias("workspace"),
        F.struct(F.when(F.col("role") != "system", F.concat(F.lit("{r"), F.col("conv_id") % 3, F.lit("}"))).alias("uuid")).alias("repository"),
        F.struct((F.col("conv_id") + 1).alias("id"), link(F.concat(F.lit("https://pr.test/"), number)).alias("links")).alias("pullrequest"),
        F.struct(F.when(turn != 3, turn + 1).alias("id")).alias("comment"),
        F.struct(said.alias("raw")).alias("content"),
        user.alias("user"),
        link(F.concat(F.lit("https://c.test/"), turn.cast("string"))).alias("links"),
    )
    rows = t(spark, d, "conversations").select("conv_id", "turn", F.to_json(payload).alias("body"))
    flat = gates.project_bitbucket(gates.gate_bitbucket(rows))
    return flat.drop("subject_type", "email", "run_again", "avatar_url")


ANSWER_SQL = f"""said AS (
  SELECT doc_id, ({list(COMMENT_LABELS)})[doc_id % 9 + 1] AS label, doc_id % 4 = 0 AS unknown, doc_id % 5 = 0 AS missing, doc_id % 7 = 0 AS cut FROM documents)"""


@query(
    ctes(ANSWER_SQL)
    + """SELECT doc_id, 'review' AS kind, NOT (unknown OR missing OR cut) AS accepted,
  CASE WHEN NOT (unknown OR missing OR cut) THEN 'overview ' || doc_id || ' ' || label || ' 1' END AS shown FROM said
UNION ALL SELECT doc_id, 'summary', NOT (missing OR cut), CASE WHEN NOT (missing OR cut) THEN 'summary ' || doc_id END FROM said
UNION ALL SELECT doc_id, 'kept_comments', NOT (unknown OR cut), CASE WHEN NOT (unknown OR cut) THEN label || ' 2' END FROM said"""
)
def answer_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Answers of models that review, summarise and filter, some of them with unknown labels, missing fields or cut off."""
    number = F.col("doc_id")
    label = F.when(number % 4 == 0, "rant").otherwise(F.get(F.array(*[F.lit(x) for x in COMMENT_LABELS]), (number % 9).cast("int")))
    comment = F.struct(F.lit("a.py").alias("file"), F.lit(3).alias("line"), F.concat(F.lit("see "), "source").alias("content"), label.alias("label"))
    missing = number % 5 == 0
    review = F.struct(
        number.alias("pr_number"), F.array(comment).alias("comments"),
        F.when(~missing, F.concat(F.lit("overview "), number.cast("string"))).alias("code_overview"),
    )
    bodies = {
        "review": review,
        "summary": F.struct(F.when(~missing, F.concat(F.lit("summary "), number.cast("string"))).alias("pull_request_description")),
        "kept_comments": F.struct(F.array(comment, comment).alias("filtered_code_review_comments")),
    }
    first = lambda field: F.get(F.col(f"answer.{field}"), F.lit(0))["label"]
    size = lambda field: F.size(f"answer.{field}").cast("string")
    shown = {
        "review": F.concat_ws(" ", "answer.code_overview", first("comments"), size("comments")),
        "summary": F.col("answer.pull_request_description"),
        "kept_comments": F.concat_ws(" ", first("filtered_code_review_comments"), size("filtered_code_review_comments")),
    }
    parts = []
    for kind, body in bodies.items():
        whole = F.to_json(body)
        text = F.when(number % 7 == 0, F.substring(whole, 1, 12)).otherwise(whole)
        rows = responses.parse_answers(t(spark, d, "documents").select("doc_id", "source", text.alias("response")), kind)
        parts.append(rows.select("doc_id", F.lit(kind).alias("kind"), "accepted", F.when(F.col("accepted"), shown[kind]).alias("shown")))
    return reduce(DataFrame.unionByName, parts)


@query(ctes(PULLS) + "SELECT id, title, files FROM pulls WHERE id % 7 = 3")
def tenant_pull_requests(spark: SparkSession, d: str) -> DataFrame:
    """The changes of one repository, from a stored table that has a folder for each repository."""
    root = scratch_path(spark, "tenants")
    tenant = F.concat(F.lit("r"), F.col("id") % 7)
    feeds.pull_requests(spark, d).withColumn("repo_id", tenant).write.partitionBy("repo_id").parquet(f"{root}/pull_requests.parquet")
    return files.tenant_scan(files.read_table(spark, root, "pull_requests"), "r3", ["id", "title", "files"])


@query("SELECT s_suppkey AS id, s_name AS title, s_nationkey = 3 AS is_processed FROM supplier")
def issue_list(spark: SparkSession, d: str) -> DataFrame:
    """All issues as they are listed, without vectors."""
    none = {"steps": "string", "raw_body": "string", "labels": "array<string>", "culprit_pull_requests": "array<struct<pull_request_id: bigint, reason: string>>"}
    stored = feeds.issues(spark, d).withColumns({c: F.lit(None).cast(kind) for c, kind in none.items()})
    return files.list_issues(stored).select("id", "title", "is_processed")


@query(ctes(LINKS) + "SELECT issue_id, pull_request_id, (issue_id % 10)::DOUBLE AS score FROM links")
def link_list(spark: SparkSession, d: str) -> DataFrame:
    """All links as they are listed."""
    return files.list_links(feeds.links(spark, d).withColumn("score", (F.col("issue_id") % 10).cast("double")))
