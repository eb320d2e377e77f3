"""JSON columns, hashes, quotes, names and times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import dates, text
from tracewright.functions.source import is_ignored_source
from tracewright.operators import responses
from tracewright.workloads.base import query, t


@query(
    """SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE '["' || event_type || '","u' || user_id || '"]' END AS stored,
  CASE WHEN event_type = 'view' THEN 0 ELSE 2 END::INTEGER AS items,
  CASE WHEN event_type = 'view' THEN '' ELSE event_type || ',u' || user_id END AS loaded FROM events"""
)
def json_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Lists to stored JSON and back; an empty list is stored as null and read as empty."""
    items = F.when(F.col("event_type") == "view", F.array().cast("array<string>")).otherwise(
        F.array("event_type", F.concat(F.lit("u"), "user_id"))
    )
    stored = t(spark, d, "events").select("event_id", responses.to_json_list(items).alias("stored"))
    loaded = stored.withColumn("back", responses.from_json_list(F.col("stored"), "string"))
    return loaded.select(
        "event_id", "stored", F.size("back").alias("items"), F.array_join("back", ",").alias("loaded")
    )


@query(
    """SELECT event_id, event_type IN ('click', 'purchase') AS accepted,
  CASE WHEN event_type IN ('click', 'purchase') THEN CASE event_type WHEN 'click' THEN 'blame' ELSE 'code_review' END END AS command
FROM events"""
)
def parse_responses(spark: SparkSession, d: str) -> DataFrame:
    """Model answers checked against their shape: good ones, an unknown value, a missing field and cut-off text."""
    kind = F.col("event_type")
    answer = (
        F.when(kind == "click", '{"command_name": "blame"}')
        .when(kind == "purchase", '{"command_name": "code_review", "extra": 1}')
        .when(kind == "view", '{"command_name": "dance"}')
        .when(kind == "signup", F.col("props"))
        .otherwise('{"command_name": "blame"')
    )
    rows = t(spark, d, "events").select("event_id", answer.alias("response"))
    parsed = responses.parse_answers(rows, "command")
    return parsed.select("event_id", "accepted", F.when(F.col("accepted"), F.col("answer.command_name")).alias("command"))


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def sha256_text(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query(
    r"""SELECT doc_id, CASE WHEN trim(text, e' \t\n\r') = '' THEN '' ELSE
  '> ' || replace(trim(text, e' \t\n\r'), chr(10), chr(10) || '> ') END AS quoted FROM documents"""
)
def blockquotes(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", text.blockquote(F.col("text")).alias("quoted"))


@query(
    """SELECT event_id, strftime(ts, '%a, %d %b %Y %H:%M:%S') || ' +0000' AS rfc,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS iso, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS iso_second,
  strftime(ts, '%Y-%U') AS week FROM events"""
)
def time_texts(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts")
    return t(spark, d, "events").select(
        "event_id",
        dates.rfc1123(ts).alias("rfc"),
        dates.iso8601(ts).alias("iso"),
        dates.iso8601(F.date_trunc("second", ts)).alias("iso_second"),
        dates.sunday_week(ts).alias("week"),
    )


@query(
    r"""WITH plain AS (SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9\-_.]', '-', 'g') AS name FROM pages
  UNION ALL SELECT -page_id - 1, regexp_replace('.' || url || '..', '[^a-zA-Z0-9\-_.]', '-', 'g') FROM pages)
SELECT page_id, left(CASE WHEN contains(name, '..') OR starts_with(name, '.')
  THEN regexp_replace(replace(name, '..', '-'), '^\.+', '') ELSE name END, 100) AS name FROM plain"""
)
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    pages = t(spark, d, "pages").select("page_id", "url")
    odd = pages.select((-F.col("page_id") - 1).alias("page_id"), F.concat(F.lit("."), "url", F.lit("..")).alias("url"))
    return pages.unionByName(odd).select("page_id", text.safe_path_name(F.col("url")).alias("name"))


@query(
    """WITH paths AS (SELECT page_id, CASE WHEN contains(url, '/en/') THEN 'src/typesX/' WHEN contains(url, '/fr/') THEN 'src/libs/'
    ELSE 'lib/' END || 'p' || page_id || CASE WHEN contains(url, '?') THEN 'types.ts' ELSE '.ts' END AS path FROM pages)
SELECT page_id, path, starts_with(path, 'src/types') OR ends_with(path, 'types.ts') AS ignored FROM paths"""
)
def path_ignore(spark: SparkSession, d: str) -> DataFrame:
    folder = (
        F.when(F.contains("url", F.lit("/en/")), "src/typesX/")
        .when(F.contains("url", F.lit("/fr/")), "src/libs/")
        .otherwise("lib/")
    )
    suffix = F.when(F.contains("url", F.lit("?")), "types.ts").otherwise(".ts")
    paths = t(spark, d, "pages").select("page_id", F.concat(folder, F.lit("p"), "page_id", suffix).alias("path"))
    return paths.withColumn("ignored", is_ignored_source(F.col("path")))
