"""Calendar keys, labels and text forms of time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sunday_week(ts: Column) -> Column:
    """``YYYY-WW`` with weeks starting on Sunday; days before the first Sunday are week 00."""
    week = F.floor((F.dayofyear(ts) + 7 - F.dayofweek(ts)) / 7)
    return F.concat(F.year(ts).cast("string"), F.lit("-"), F.lpad(week.cast("string"), 2, "0"))


def month_start(ts: Column) -> Column:
    return F.trunc(ts.cast("date"), "month")


def month_label(day: Column) -> Column:
    return F.date_format(day, "MMM-yyyy")


def rfc1123(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))


def iso8601(ts: Column) -> Column:
    """ISO text with ``Z``; microseconds only when there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    exact = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.when(F.date_format(ts, "SSSSSS") == "000000", whole).otherwise(exact)
