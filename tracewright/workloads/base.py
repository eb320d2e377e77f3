"""Registry of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[Run], Run]:
    """Register the function under its name, with the SQL that gives the same rows."""

    def keep(run: Run) -> Run:
        REGISTRY[run.__name__] = Query(run.__name__, run, sql)
        return run

    return keep


def t(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
