"""Deploy blockers and merged changes over time."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.dates import month_label, month_start, sunday_week
from tracewright.functions.numbers import effort_hours, effort_usd, hours_text, usd_text

DEPLOY = ["deploy_number", "deploy_url", "created_at"]
BLOCKERS = "blockers"
TIMED = (T.TimestampType, T.TimestampNTZType, T.DateType)


def _known(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Groups with a missing key do not count."""
    return df.dropna(subset=list(columns))


def deploy_counts(blockers: DataFrame) -> DataFrame:
    """Blockers by deploy, unknown ones included: what all other counts are sums of, so the rows are read once."""
    return blockers.groupBy(*DEPLOY).agg(F.count(F.lit(1)).alias(BLOCKERS))


def blockers_per_deploy(blockers: DataFrame) -> DataFrame:
    return _known(deploy_counts(blockers), DEPLOY)


def per_month(rows: DataFrame, date: str, name: str) -> DataFrame:
    return (
        _known(rows, [date]).groupBy(month_start(F.col(date)).alias("month")).agg(F.count(F.lit(1)).alias(name))
    )


def blockers_per_month(blockers: DataFrame) -> DataFrame:
    """Blockers by calendar month with the estimated effort; texts only from 5 hours and 1000 dollars on."""
    hours, usd = effort_hours(F.col(BLOCKERS)), effort_usd(F.col(BLOCKERS))
    return per_month(blockers, "created_at", BLOCKERS).select(
        F.year("month").alias("year"),
        F.month("month").alias("month"),
        month_label(F.col("month")).alias("label"),
        BLOCKERS,
        hours.alias("hours"),
        usd.alias("usd"),
        F.when(hours >= 5, hours_text(hours)).alias("hours_label"),
        F.when(usd >= 1000, usd_text(usd)).alias("usd_label"),
    )


def blockers_per_week(blockers: DataFrame) -> DataFrame:
    week = sunday_week(F.col("created_at")).alias("week")
    return _known(blockers, ["created_at"]).groupBy(week).agg(F.count(F.lit(1)).alias(BLOCKERS))


def deploys_per_month(blockers: DataFrame) -> DataFrame:
    deploys = blockers.select("deploy_number", "created_at").distinct()
    return (
        _known(deploys, ["created_at"])
        .groupBy(F.year("created_at").alias("year"), F.month("created_at").alias("month"))
        .agg(F.count(F.lit(1)).alias("deploys"))
    )


def blocker_averages(blockers: DataFrame) -> DataFrame:
    """Means per deploy, month and week, and medians per month and week.

    All four lines come from the counts by deploy, whose shuffle they share. The medians run over calendar buckets, whose
    number is set by the dates, not by the rows.
    """
    counts = deploy_counts(blockers)
    known = lambda keys: reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])

    def line(frame: DataFrame, measure: str, keys: Sequence[str], with_median: bool = False) -> DataFrame:
        # a filter would be pushed below the counts by deploy, which then could not be shared
        value = F.when(known(keys), F.col(BLOCKERS))
        middle = F.median(value) if with_median else F.lit(None).cast("double")
        return frame.agg(F.avg(value).alias("mean"), middle.alias("median")).select(
            F.lit(measure).alias("measure"), "mean", "median"
        )

    def summed(key: Column) -> DataFrame:
        return counts.groupBy(key.alias("key")).agg(F.sum(BLOCKERS).alias(BLOCKERS))

    deploys = counts.groupBy("deploy_number", "created_at").agg(F.sum(BLOCKERS).alias(BLOCKERS))
    per_month_ = deploys.groupBy(month_start(F.col("created_at")).alias("key")).agg(F.count_if(F.col(BLOCKERS) > 0).alias(BLOCKERS))
    lines = [
        line(counts, "blockers per deploy", DEPLOY),
        line(per_month_, "deploys per month", ["key"]),
        line(summed(month_start(F.col("created_at"))), "blockers per month", ["key"], True),
        line(summed(sunday_week(F.col("created_at"))), "blockers per week", ["key"], True),
    ]
    return reduce(DataFrame.unionByName, lines)


STATISTICS = (("25%", 0.25), ("50%", 0.5), ("75%", 0.75))
ACCURACY = 100_000
#: Distinct values between the two bounds of one quantile that may come to the driver; more of them are narrowed down first.
NEAR = 200_000
_BOUND = "column string, label string, lo double, hi double, below long, rank double"


def _unpivoted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, v): one row for each value, times in seconds since 1970; nulls are left out."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cells = []
    for name in columns:
        value = F.unix_micros(F.col(name).cast("timestamp")) / 1_000_000 if isinstance(kinds[name], TIMED) else F.col(name)
        cells.append(F.struct(F.lit(name).alias("column"), value.cast("double").alias("v")))
    return df.select(F.inline(F.array(*cells))).filter(F.col("v").isNotNull())


def _between(values: DataFrame, bounds: list[tuple]) -> DataFrame:
    """(column, label, v, n): how often each value between the bounds occurs, and in a row without value how many lie below."""
    spark = values.sparkSession
    table = F.broadcast(spark.createDataFrame(bounds, _BOUND).select("column", "label", "lo", "hi"))  # a line for each quantile
    inside = values.join(table, "column").filter(F.col("v") <= F.col("hi"))
    return inside.groupBy("column", "label", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("n"))


def _pick(rows: list[tuple[float | None, int]], rank: float) -> float:
    """The value at a rank (from 0) that may lie between two values, from the counts of those around it."""
    begin = sum(n for v, n in rows if v is None)
    low = high = None
    for v, n in sorted(r for r in rows if r[0] is not None):
        if begin <= math.floor(rank) < begin + n:
            low = v
        if begin <= math.ceil(rank) < begin + n:
            high = v
        begin += n
    return low + (high - low) * (rank - math.floor(rank))


def _quantiles(values: DataFrame, known: dict[str, tuple], near: int) -> dict[tuple[str, str], float]:
    """Exact quantiles of all columns: approximate ones on both sides bound where they lie, and only values between are counted.

    ``known`` has the number of values and the bounds of each column. Should too many values lie between the bounds, they are drawn
    nearer by approximate quantiles of those values, as often as needed.
    """
    bounds, found = [], {}
    for name, (count, sides, ends) in known.items():
        for k, (label, q) in enumerate(STATISTICS):
            lo, hi = sides[2 * k : 2 * k + 2] if count >= 2 * ACCURACY else ends  # nearer to a rank than one row of so few
            bounds.append((name, label, float(lo), float(hi), 0, q * (count - 1)))
    while bounds:
        counted = _between(values, bounds)
        sizes = {(r[0], r[1]): r[2] for r in counted.groupBy("column", "label").agg(F.count("v")).collect()}
        small = [b for b in bounds if sizes.get(b[:2], 0) <= near]
        if small:
            rows: dict[tuple[str, str], list] = {b[:2]: [] for b in small}
            wanted = values.sparkSession.createDataFrame([b[:2] for b in small], "column string, label string")
            for column, label, v, n in counted.join(F.broadcast(wanted), ["column", "label"]).select("column", "label", "v", "n").collect():
                rows[column, label].append((v, n))
            found |= {b[:2]: _pick(rows[b[:2]], b[5]) for b in small}
        nearer = []
        for b in (b for b in bounds if b not in small):
            part = values.filter((F.col("column") == b[0]) & (F.col("v") >= b[2]) & (F.col("v") <= b[3]))
            below, size = values.filter((F.col("column") == b[0]) & (F.col("v") < b[2])).count(), part.count()
            at = [min(1.0, max(0.0, (b[5] + d - below) / max(size - 1, 1))) for d in (-size / ACCURACY * 4 - 1, size / ACCURACY * 4 + 1)]
            lo, hi = part.agg(F.percentile_approx("v", at, ACCURACY)).first()[0]
            nearer.append((*b[:2], lo, hi, *b[4:]))
        bounds = nearer
    return found


def describe(df: DataFrame, columns: Sequence[str] | None = None, near: int = NEAR) -> DataFrame:
    """count, mean, std, min, quartiles and max of numeric and time columns, one row per column.

    Times are seconds since 1970 and have no deviation. Quartiles are exact. All columns go through two aggregations together: the
    first gives everything but the quartiles and bounds for those, the second counts the values between the bounds.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    chosen = list(columns or [n for n, k in kinds.items() if isinstance(k, (T.NumericType, *TIMED))])
    values = _unpivoted(df, chosen)
    sides = [min(1.0, max(0.0, q + d)) for _, q in STATISTICS for d in (-3 / ACCURACY, 3 / ACCURACY)]
    basic = values.groupBy("column").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.percentile_approx("v", sides, ACCURACY).alias("sides"),
    )
    rows = {r["column"]: r for r in basic.collect()}  # one for each column
    quartiles = _quantiles(values, {c: (r["count"], r["sides"], (r["min"], r["max"])) for c, r in rows.items()}, near)
    out = []
    for name in chosen:
        r = rows.get(name)
        spread = None if r is None or isinstance(kinds[name], TIMED) else r["std"]
        middle = [quartiles.get((name, label)) for label, _ in STATISTICS]
        out.append((name, r["count"], r["mean"], spread, r["min"], *middle, r["max"]) if r else (name, 0, *[None] * 7))
    labels = ", ".join(f"`{label}` double" for label, _ in STATISTICS)
    return df.sparkSession.createDataFrame(out, f"column string, count long, mean double, std double, min double, {labels}, max double")


def merged_and_fixes(merged: DataFrame, fixes: DataFrame, excluded: tuple[int, int] = (2025, 6)) -> DataFrame:
    """Merged changes and fixes side by side per month, without an unfinished (year, month)."""
    year, month = excluded

    def monthly(rows: DataFrame, name: str) -> DataFrame:
        counts = per_month(rows, "date", name)
        return counts.filter(~((F.year("month") == year) & (F.month("month") == month)))

    both = monthly(merged, "merged").join(monthly(fixes, "fixes"), "month", "full").fillna(0, ["merged", "fixes"])
    return both.select(
        "month",
        month_label(F.col("month")).alias("label"),
        "merged",
        "fixes",
        effort_hours(F.col("fixes")).alias("fix_hours"),
    )
