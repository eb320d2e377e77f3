"""The deploy-blocker report from its exported files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.operators import delivery
from tracewright.operators.ordering import keep_first
from tracewright.sources.files import read_blockers, read_merged


def deploy_report(spark: SparkSession, blockers_csv: str, fixes_csv: str, merged_csv: str) -> dict[str, DataFrame]:
    """All frames of the report by name."""
    blockers = read_blockers(spark, blockers_csv)
    fixes = keep_first(read_merged(spark, fixes_csv, "date"), ["id"], "row")
    merged = keep_first(read_merged(spark, merged_csv, "merged_at"), ["id"], "row")
    return {
        "blockers_per_deploy": delivery.blockers_per_deploy(blockers),
        "deploys_per_month": delivery.deploys_per_month(blockers),
        "blockers_per_month": delivery.blockers_per_month(blockers),
        "blockers_per_week": delivery.blockers_per_week(blockers),
        "averages": delivery.blocker_averages(blockers),
        "fixes_described": delivery.describe(fixes, ["id", "date"]),
        "merged_described": delivery.describe(merged, ["id", "date"]),
        "merged_and_fixes": delivery.merged_and_fixes(merged, fixes),
    }
