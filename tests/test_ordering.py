"""Order-dependent operators on skewed input."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import ordering


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one key; the order column is shuffled."""
    rng = np.random.default_rng(7)
    rows = [(int(i), 0 if i % 3 == 0 else int(rng.integers(1, 40)), float(rng.integers(0, 25))) for i in rng.permutation(6000)]
    return spark.createDataFrame(rows, "id bigint, key bigint, value double").repartition(7), rows


def test_sequence_is_dense_and_ordered(skewed):
    df, rows = skewed
    got = ordering.sequence_rows(df, [F.desc("value"), "id"], 10, "n").select("n", "id").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(10, 6010))
    assert [r["id"] for r in got] == [i for i, _, v in sorted(rows, key=lambda r: (-r[2], r[0]))]


def test_sequence_of_nothing(spark):
    empty = spark.createDataFrame([], "id bigint")
    assert ordering.sequence_rows(empty, ["id"]).count() == 0


def test_chunks_hold_everything(skewed):
    df, rows = skewed
    lists = ordering.ordered_chunks(df, ["key"], ["id"], F.col("id"), 100).orderBy("key", "chunk").collect()
    assert max(len(r["items"]) for r in lists) <= 100
    whole = {}
    for r in lists:
        whole.setdefault(r["key"], []).extend(r["items"])
    assert whole == {k: sorted(i for i, key, _ in rows if key == k) for k in {r[1] for r in rows}}


@pytest.mark.parametrize(("first", "last"), [(1, 25), (26, 50), (1001, 1100)])
def test_rank_slice(skewed, first, last):
    df, rows = skewed
    got = ordering.rank_slice(df, ["key"], [F.desc("value"), F.asc("id")], first, last, ["id"]).collect()
    want = set()
    for k in {r[1] for r in rows}:
        best = sorted((r for r in rows if r[1] == k), key=lambda r: (-r[2], r[0]))
        want |= {(k, r[0], n) for n, r in enumerate(best, 1) if first <= n <= last}
    assert {(r["key"], r["id"], r["rank"]) for r in got} == want


def test_rank_is_trimmed_before_the_shuffle(skewed):
    df, _ = skewed
    top = ordering.rank_slice(df, ["key"], [F.desc("value"), F.asc("id")], 1, 25, ["id"])
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_quantiles_with_heavy_ties(skewed):
    df, rows = skewed
    ones = df.withColumn("value", F.when(F.col("key") == 0, 3.5).otherwise(F.col("value") + F.col("id") / 7))
    values = [3.5 if k == 0 else v + i / 7 for i, k, v in rows]
    wanted = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = dict(ordering.exact_quantiles(ones, "value", wanted).collect())
    assert [got[q] for q in wanted] == pytest.approx(list(np.quantile(values, wanted)), abs=1e-9)


def test_quantiles_of_one_value(spark):
    df = spark.createDataFrame([(2.0,), (None,)], "v double")
    assert dict(ordering.exact_quantiles(df, "v", [0.25, 1.0]).collect()) == {0.25: 2.0, 1.0: 2.0}


def test_keep_first_and_latest(spark):
    df = spark.createDataFrame(
        [(1, "a", None), (2, "a", None), (3, None, "x"), (4, None, "x"), (5, "x", None)], "n int, k string, l string"
    )
    assert sorted(r["n"] for r in ordering.keep_first(df, ["k", "l"], "n").collect()) == [1, 3, 5]
    known = df.filter("k is not null")
    assert sorted(r["n"] for r in ordering.latest_by(known, ["k"], "n").collect()) == [2, 5]


def test_previous_across_files(skewed):
    df, rows = skewed
    got = {r["id"]: r["prev_id"] for r in ordering.previous_in_group(df, ["key"], ["value", "id"], ["id"]).collect()}
    want = {}
    for k in {r[1] for r in rows}:
        ids = [i for i, key, v in sorted(rows, key=lambda r: (r[2], r[0])) if key == k]
        want |= dict(zip(ids, [None, *ids]))
    assert got == want


def test_hot_key_spans_files(spark, skewed):
    """Sorting by the whole order spreads one key over several tasks."""
    df, _ = skewed
    # small partitions would be joined up again
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = ordering._sorted_table(df, ["key", "value", "id"])
        files = dict(table.groupBy("_part").count().collect())
        lagged = ordering.previous_in_group(df, ["key"], ["value", "id"], ["id"])
        assert lagged.filter("prev_id is null").count() == lagged.select("key").distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(files) > 4 and max(files.values()) < 2000
    assert table.filter("key = 0").select("_part").distinct().count() > 1
