"""Statistics of several columns at once, and how often the rows are read for them."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewright.operators import delivery


@pytest.mark.parametrize("near", [200_000, 40])
def test_quartiles_are_exact_however_far_they_are_narrowed(spark, near, monkeypatch):
    rng = random.Random(1)
    frame = pd.DataFrame({"a": [rng.gauss(0, 1) for _ in range(1500)], "b": [rng.randint(0, 4) for _ in range(1500)], "c": [float(i) for i in range(1500)]})
    frame.loc[frame.index % 7 == 0, "a"] = None
    monkeypatch.setattr(delivery, "ACCURACY", 100)  # wide bounds: many values lie between them
    got = {r["column"]: r for r in delivery.describe(spark.createDataFrame(frame).repartition(3).withColumn("a", F.when(~F.isnan("a"), F.col("a"))), near=near).collect()}
    want = frame.describe()
    for name in frame.columns:
        for stat in ("count", "mean", "std", "min", "25%", "50%", "75%", "max"):
            assert got[name][stat] == pytest.approx(want[name][stat]), (name, stat)


def test_empty_and_single_columns(spark):
    df = spark.createDataFrame([(1.5, None), (None, None)], "a double, b double")
    rows = {r["column"]: r for r in delivery.describe(df).collect()}
    assert (rows["a"]["count"], rows["a"]["50%"], rows["a"]["std"]) == (1, 1.5, None)
    assert rows["b"]["count"] == 0 and rows["b"]["max"] is None


def test_averages_read_the_rows_once(spark, tmp_path):
    rows = [(i % 9, f"u{i % 9}", i % 9) for i in range(100)] + [(None, "u", 3), (1, None, 200)]
    df = spark.createDataFrame(rows, "deploy_number long, deploy_url string, d int")
    df.select("deploy_number", "deploy_url", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")).cast("timestamp").alias("created_at")).write.parquet(str(tmp_path / "b"))
    averages = delivery.blocker_averages(spark.read.parquet(str(tmp_path / "b")))
    got = {r["measure"]: (r["mean"], r["median"]) for r in averages.collect()}
    assert got["blockers per deploy"] == (pytest.approx(100 / 9), None) and got["blockers per month"] == (51.0, 51.0)
    plan = averages._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert final.count("ReusedExchange") >= 3 and final.count("FileScan") == 1
