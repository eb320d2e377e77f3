"""Usage and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import ledger, state
from tracewright.sources.files import lookup
from tracewright.workloads import feeds
from tracewright.workloads.base import ctes, query, t
from tracewright.workloads.feeds import CALLS, LOGS


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return ledger.price_calls(feeds.model_calls(spark, d))


@query(
    ctes(LOGS, CALLS)
    + """, totals AS (SELECT usage_log_id, count(*) AS calls, sum(tokens_used)::BIGINT AS tokens_used,
  sum(cost_usd_thousandths)::BIGINT AS cost_usd_thousandths FROM calls GROUP BY ALL)
SELECT l.id, c.c_name AS username, l.command_name, l.comment_url, l.created_at, coalesce(t.calls, 0) AS calls,
  coalesce(t.tokens_used, 0) AS tokens_used, coalesce(t.cost_usd_thousandths, 0) AS cost_usd_thousandths
FROM logs l JOIN customer c ON c.c_custkey = l.user_id LEFT JOIN totals t ON t.usage_log_id = l.id"""
)
def usage_report(spark: SparkSession, d: str) -> DataFrame:
    totals = ledger.usage_totals(feeds.usage_logs(spark, d), feeds.users(spark, d), _calls(spark, d))
    return ledger.newest_first(totals).select(
        "id", "username", "command_name", "comment_url", "created_at", "calls", "tokens_used", "cost_usd_thousandths"
    )


@query(
    ctes(LOGS, CALLS)
    + """, numbered AS (
  SELECT *, row_number() OVER (ORDER BY usage_log_id, line_number, part, supplier) - 1 AS id FROM calls),
placed AS (SELECT *, row_number() OVER (PARTITION BY usage_log_id ORDER BY id) - 1 AS place FROM numbered)
SELECT l.id, l.command_name, c.c_name AS username, coalesce(p.place // 5, 0)::BIGINT AS chunk,
  coalesce(string_agg(p.id || ':' || p.llm_model || ':' || p.tokens_used || ':' || p.cost_usd_thousandths, ',' ORDER BY p.place), '')
    AS llm_calls
FROM logs l JOIN customer c ON c.c_custkey = l.user_id LEFT JOIN placed p ON p.usage_log_id = l.id
GROUP BY ALL"""
)
def usage_report_nested(spark: SparkSession, d: str) -> DataFrame:
    """Requests with their calls nested, here at most five to a row."""
    order = ["usage_log_id", "line_number", "part", "supplier"]
    calls = state.new_model_calls(feeds.model_calls(spark, d), order, 0, F.lit("2025-01-01").cast("timestamp"))
    nested = ledger.nested_usage(feeds.usage_logs(spark, d), feeds.users(spark, d), calls, 5)
    shown = lambda c: F.concat_ws(":", c["id"], c["llm_model"], c["tokens_used"], c["cost_usd_thousandths"])
    return nested.select(
        "id",
        "usage_log.command_name",
        "user.username",
        "chunk",
        F.array_join(F.transform("llm_calls", shown), ",").alias("llm_calls"),
    )


@query(
    ctes(LOGS)
    + """SELECT c.c_name AS username, count(*) AS requests, max(l.created_at) AS latest
FROM logs l JOIN customer c ON c.c_custkey = l.user_id GROUP BY c.c_name"""
)
def usage_by_user(spark: SparkSession, d: str) -> DataFrame:
    rows = ledger.logs_by_username(feeds.usage_logs(spark, d), feeds.users(spark, d))
    return rows.groupBy("username").agg(F.count(F.lit(1)).alias("requests"), F.max("created_at").alias("latest"))


@query(
    """WITH names AS (SELECT DISTINCT 'Customer#' || lpad((user_id * 11)::VARCHAR, 9, '0') AS username FROM events)
SELECT n.username, c.c_custkey AS id, c.c_acctbal > 0 AS is_active FROM names n LEFT JOIN customer c ON c.c_name = n.username"""
)
def user_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Users by name for every name seen in events; unknown names give nulls."""
    name = F.concat(F.lit("Customer#"), F.lpad((F.col("user_id") * 11).cast("string"), 9, "0"))
    names = t(spark, d, "events").select(name.alias("username")).distinct()
    return lookup(names, feeds.users(spark, d), ["username"]).select("username", "id", "is_active")


@query(
    """SELECT c_custkey AS id, c_name AS username, NULL::VARCHAR AS email, c_mktsegment || ' ' || c_nationkey AS name,
  'https://img.test/' || c_custkey AS avatar_url, c_acctbal > 0 AS is_active FROM customer"""
)
def user_list(spark: SparkSession, d: str) -> DataFrame:
    return ledger.user_list(feeds.users(spark, d))


@query(
    ctes(CALLS)
    + "SELECT usage_log_id, line_number, part, supplier, llm_model, tokens_used, cost_usd_thousandths FROM calls"
)
def model_call_costs(spark: SparkSession, d: str) -> DataFrame:
    return _calls(spark, d).drop("created_at")


@query(
    ctes(CALLS)
    + """SELECT llm_model, count(*) AS calls, sum(tokens_used)::BIGINT AS tokens_used,
  sum(cost_usd_thousandths)::BIGINT AS cost_usd_thousandths FROM calls GROUP BY llm_model"""
)
def model_cost_totals(spark: SparkSession, d: str) -> DataFrame:
    return ledger.cost_by_model(_calls(spark, d))
