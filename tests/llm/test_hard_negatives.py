"""Hard negatives against all scores; blocks, zone maps, their levels, and odd input."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import hard_negatives as hard
from tracewright.llm.base import Workspace


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (1, 5)])
def test_the_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    place = hard.hilbert(cells, bits)
    assert sorted(place.tolist()) == list(range(1 << (bits * dims)))
    walk = cells[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def odd_vectors(rng) -> list[tuple]:
    middles = rng.normal(size=(4, 6))
    rows = [(i, int(c), [float(x) for x in middles[c] + 0.4 * rng.normal(size=6)]) for i, c in enumerate(rng.integers(0, 4, 700))]
    rows += [(2000 + i, 1, [0.5] * 6) for i in range(350)]  # one vector on a third of the rows
    rows += [(900, 2, None), (1000, None, [1.0] * 6), (1100, 1, [float("nan")] * 6), (1200, 1, []), (1300, 1, [1.0, None]), (1400, 3, [2.0, 1.0]), (None, 1, [1.0] * 6)]
    return rows + [(100, 2, rows[3][2]), (100, 2, rows[3][2]), (7, 0, rows[5][2]), (1500, 9, [0.1] * 6), (1600, 1, [0.0] * 6)]


def plain(rows: list[tuple], every: int, positives: int, negatives: int) -> list[tuple]:
    good = [(i, k, tuple(np.floor(256 * np.pad(np.array(v, np.float32).astype(float), (0, 6 - len(v)))).astype(int).tolist())) for i, k, v in rows
            if i is not None and k is not None and v and None not in v and np.isfinite(v).all()]
    out = []
    for i, k, a in {r for r in good if r[0] % every == 0}:
        scored = sorted((-sum(p * q for p, q in zip(a, x)), j, c) for j, c, x in good if j != i)
        for s, j, _ in [r for r in scored if r[2] == k][:positives]:
            fit = [r for r in scored if r[2] != k and 30 * -s <= 100 * -r[0] <= 90 * -s][:negatives]
            out += [(i, j, n + 1, m, -s, -t) for n, (t, m, _) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("block, top", [(2048, 4096), (16, 4096), (16, 3)])
def test_negatives_are_those_of_all_scores(spark, block, top):
    rows = odd_vectors(np.random.default_rng(5))
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    for name in ("block", "key", "lows", "node", "place"):
        df = df.withColumn(name, F.lit("x"))
    ws = Workspace(spark, "test")
    found = hard.mine(df, ws, every=50, block=block, top=top)
    assert sorted(map(tuple, found.collect())) == plain(rows, 50, 5, 10)
    assert hard.mine(df.limit(0), ws).count() == 0
    ws.close()


def test_zones_hold_their_blocks_and_spare_reading(spark):
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(40, 8))
    middles *= 3 / np.linalg.norm(middles, axis=1)[:, None]
    rows = [(i, int(i % 2), [float(x) for x in middles[i % 40] + 0.05 * rng.normal(size=8)]) for i in range(4000)]
    ws = Workspace(spark, "test")
    whole = ws.write(hard.whole_rows(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")), "whole")
    for top in (4096, 4):
        index = hard.Index(whole, ws, 32, top)
        assert index.blocks.groupBy("block").agg(F.count("*").alias("n"), F.count_distinct("label").alias("l")).where("n > 32 OR l > 1").count() == 0
        assert len(index.zones) == (1 if top == 4096 else len(index.shifts) + 1)
        zones = index.zones[0].withColumnRenamed("node", "block")
        outside = index.blocks.join(zones, "block").where("exists(zip_with(v, zip_with(lo, hi, (a, b) -> struct(a, b)), (x, e) -> x < e.a OR x > e.b), t -> t)")
        assert outside.count() == 0
        asks = whole.where("vec_id % 100 = 0").select("vec_id", "key", "label", "v", F.array(F.lit(450_000).cast("long")).alias("lows"), F.array(F.lit(hard._MOST)).alias("highs"))
        routed = hard.route(asks, index, same=True)
        blocks = zones.count()
        assert 0 < routed.count() < asks.count() * blocks / 8  # the windows need few of the blocks
        scored = asks.alias("a").join(index.blocks.alias("b"), F.col("a.label") == F.col("b.label")).where("aggregate(zip_with(a.v, b.v, (x, y) -> x * y), 0D, (s, p) -> s + p) >= 450000")
        needed = scored.select("a.vec_id", F.col("b.block").alias("node")).distinct()
        assert needed.join(routed, ["vec_id", "node"], "left_anti").count() == 0
    ws.close()


def test_scores_beyond_doubles(spark):
    rows = [(0, 1, [1e6, 1e6]), (1, 1, [1e6, 1.0]), (2, 2, [3e5, 2.0]), (3, 2, [9e5, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    ws = Workspace(spark, "test")
    one = 256**2 * (10**12 + 10**6)
    scores = {3: 256**2 * (9 * 10**11 + 10**6), 2: 256**2 * (3 * 10**11 + 2 * 10**6)}
    want = [(0, 1, n + 1, i, one, s) for n, (i, s) in enumerate((i, s) for i, s in scores.items() if 30 * one <= 100 * s <= 90 * one)]
    assert [tuple(r) for r in hard.mine(df, ws).orderBy("rank").collect()] == want
    ws.close()
