"""Deploy blockers and merged changes over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import delivery
from tracewright.operators.ordering import keep_first
from tracewright.workloads import feeds
from tracewright.workloads.base import ctes, query, t
from tracewright.workloads.feeds import BLOCKERS

MONTHS = """monthly AS (SELECT year(created_at)::INTEGER AS year, month(created_at)::INTEGER AS month, count(*) AS blockers
  FROM blockers GROUP BY ALL)"""
WEEKS = "weekly AS (SELECT strftime(created_at, '%Y-%U') AS week, count(*) AS blockers FROM blockers GROUP BY ALL)"


@query(
    ctes(BLOCKERS) + "SELECT deploy_number, deploy_url, created_at, count(*) AS blockers FROM blockers GROUP BY ALL"
)
def blockers_per_deploy(spark: SparkSession, d: str) -> DataFrame:
    return delivery.blockers_per_deploy(feeds.blockers(spark, d))


@query(
    ctes(BLOCKERS, MONTHS)
    + """, effort AS (SELECT *, blockers * (5.0::DOUBLE / 60) AS h, blockers * (5.0::DOUBLE / 60) * 100 AS u FROM monthly)
SELECT year, month, strftime(make_date(year, month, 1), '%b-%Y') AS label, blockers, round(h, 6) AS hours, round(u, 6) AS usd,
  CASE WHEN h >= 10 THEN format('{:.0f}h', h) WHEN h >= 5 THEN format('{:.1f}h', h) END AS hours_label,
  CASE WHEN u >= 1000 THEN format('{:.1f}K', u / 1000) END AS usd_label
FROM effort"""
)
def blockers_per_month(spark: SparkSession, d: str) -> DataFrame:
    rows = delivery.blockers_per_month(feeds.blockers(spark, d))
    return rows.withColumns({"hours": F.round("hours", 6), "usd": F.round("usd", 6)})


@query(ctes(BLOCKERS, WEEKS) + "SELECT * FROM weekly")
def blockers_per_week(spark: SparkSession, d: str) -> DataFrame:
    return delivery.blockers_per_week(feeds.blockers(spark, d))


DEPLOYS = """deploys AS (SELECT year(created_at)::INTEGER AS year, month(created_at)::INTEGER AS month, count(*) AS deploys
  FROM (SELECT DISTINCT deploy_number, created_at FROM blockers) GROUP BY ALL)"""


@query(ctes(BLOCKERS, DEPLOYS) + "SELECT * FROM deploys")
def deploys_per_month(spark: SparkSession, d: str) -> DataFrame:
    return delivery.deploys_per_month(feeds.blockers(spark, d))


@query(
    ctes(BLOCKERS, MONTHS, WEEKS, DEPLOYS)
    + """SELECT 'blockers per deploy' AS measure, round(avg(n), 6) AS mean, NULL::DOUBLE AS median
FROM (SELECT count(*) AS n FROM blockers GROUP BY deploy_number, deploy_url, created_at)
UNION ALL SELECT 'deploys per month', round(avg(deploys), 6), NULL FROM deploys
UNION ALL SELECT 'blockers per month', round(avg(blockers), 6), median(blockers) FROM monthly
UNION ALL SELECT 'blockers per week', round(avg(blockers), 6), median(blockers) FROM weekly"""
)
def blocker_averages(spark: SparkSession, d: str) -> DataFrame:
    rows = delivery.blocker_averages(feeds.blockers(spark, d))
    return rows.withColumn("mean", F.round("mean", 6))


@query(
    """WITH v AS (SELECT 'o_orderkey' AS "column", o_orderkey::DOUBLE AS v FROM orders
  UNION ALL SELECT 'o_totalprice', o_totalprice FROM orders
  UNION ALL SELECT 'o_orderdate', epoch(o_orderdate) FROM orders)
SELECT "column", count(v) AS count, round(avg(v), 4) AS mean,
  CASE WHEN "column" <> 'o_orderdate' THEN round(stddev_samp(v), 4) END AS std, min(v) AS min,
  round(quantile_cont(v, 0.25), 4) AS "25%", round(quantile_cont(v, 0.5), 4) AS "50%",
  round(quantile_cont(v, 0.75), 4) AS "75%", max(v) AS max
FROM v GROUP BY "column" """
)
def described(spark: SparkSession, d: str) -> DataFrame:
    rows = delivery.describe(t(spark, d, "orders"), ["o_orderkey", "o_totalprice", "o_orderdate"])
    return rows.withColumns({c: F.round(c, 4) for c in ("mean", "std", "25%", "50%", "75%")})


@query(
    """WITH merged AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders GROUP BY ALL),
fixes AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders
  WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' GROUP BY ALL),
both_sides AS (SELECT coalesce(m.month, f.month) AS month, coalesce(m.n, 0) AS merged, coalesce(f.n, 0) AS fixes
  FROM merged m FULL JOIN fixes f ON f.month = m.month)
SELECT month, strftime(month, '%b-%Y') AS label, merged, fixes, round(fixes * (5.0::DOUBLE / 60), 6) AS fix_hours
FROM both_sides WHERE NOT (year(month) = 1998 AND month(month) = 6)"""
)
def merged_vs_fix(spark: SparkSession, d: str) -> DataFrame:
    orders = t(spark, d, "orders").withColumnRenamed("o_orderdate", "date")
    fixes = orders.filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F"))
    rows = delivery.merged_and_fixes(orders, fixes, (1998, 6))
    return rows.withColumn("fix_hours", F.round("fix_hours", 6))


@query("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def first_by_text(spark: SparkSession, d: str) -> DataFrame:
    """The earliest document of each text."""
    return keep_first(t(spark, d, "documents"), ["text"], "doc_id").select("doc_id", "text")
