"""Scores by cells: the same scores as by joins, and vectors that are sent once for each cell."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import similarity


def vectors(spark, key, n, seed):
    rng = np.random.default_rng(seed)
    rows = [("r" if i % 5 else "s", i, [float(x) for x in rng.normal(size=6)]) for i in range(n)]
    rows += [("r", n + 1, [0.0] * 6), ("r", n + 2, None)]
    return spark.createDataFrame(rows, f"repo_id string, {key} long, embedding array<float>").repartition(3)


def links(spark, issues, each, pulls):
    rows = [("r" if i % 5 else "s", i, (i * 7 + k * 5) % pulls) for i in range(issues + 4) for k in range(each)]
    rows += [("r", 1, pulls + 1), ("r", 1, pulls + 2), ("r", 1, pulls + 3)] + [("r", i, 1) for i in range(issues)]
    return spark.createDataFrame(rows + rows[:9], "repo_id string, issue_id long, pull_request_id long").repartition(4)


@pytest.mark.parametrize("block", [1, 7, 512])
def test_same_scores_as_by_joins(spark, block):
    issue, pull, pairs = vectors(spark, "issue_id", 60, 1), vectors(spark, "pull_request_id", 90, 2), links(spark, 60, 9, 90)
    want = {tuple(r)[:3]: r["score"] for r in similarity.score_links(pairs.distinct(), issue, pull).collect()}
    found = similarity.score_links(pairs, issue, pull, block=block)
    rows = found.collect()
    got = {tuple(r)[:3]: r["score"] for r in rows}
    assert len(rows) == len(got) and found.columns == ["repo_id", "issue_id", "pull_request_id", "score"]
    assert set(got) == set(want) and got[("r", 1, 91)] is None
    assert all(w is None or math.isclose(got[k], w, rel_tol=1e-12) for k, w in want.items())
    assert similarity.score_links(pairs.limit(0), issue, pull, block=block).count() == 0
    assert similarity.score_links(pairs, issue.limit(0), pull, block=block).count() == 0


def test_copies_do_not_grow_with_links(spark):
    pull = similarity._prepared(vectors(spark, "pull_request_id", 80, 3), "pull_request_id")

    def copies(each: int) -> int:
        cells = similarity.in_cells(links(spark, 80, each, 80).distinct(), 4, 4)
        return similarity.vectors_of_cells(cells, pull, "pull_request_id", "pulls").agg(F.sum(F.size("pulls"))).first()[0]

    few, many, most = copies(1), copies(8), copies(64)
    assert few < many <= most <= 4 * 82  # a vector goes to each of its four cells at most: never once for each of 64 links


def test_cells_meet_without_another_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scored = similarity.score_links(links(spark, 20, 3, 20), vectors(spark, "issue_id", 20, 4), vectors(spark, "pull_request_id", 20, 5))
        plan = scored._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = plan[: plan.index("ObjectHashAggregate")]  # from the scores down to the lists of the cells
    assert "SortMergeJoin" in above and "Exchange" not in above
    assert "BroadcastNestedLoop" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("smaller", ["issue", "pull"])
def test_few_vectors_are_sent_and_the_others_shuffled_once(spark, smaller, monkeypatch):
    issues, pulls = (20, 300) if smaller == "issue" else (300, 20)
    issue, pull, pairs = vectors(spark, "issue_id", issues, 6), vectors(spark, "pull_request_id", pulls, 7), links(spark, issues, 9, pulls)
    want = sorted((tuple(r) for r in similarity.score_links(pairs, issue, pull).collect()), key=str)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    monkeypatch.setattr(similarity, "SENT", 5_000)
    try:
        scored = similarity.score_links(pairs, issue, pull)
        plan = scored._jdf.queryExecution().executedPlan().toString()
        got = sorted((tuple(r) for r in scored.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == want and len(want) > 100
    assert "BroadcastHashJoin" in plan and "collect_list" not in plan and "issue_block" not in plan
    wide = plan[plan.index("BroadcastHashJoin") : plan.index("SortMergeJoin")]
    assert "Exchange" not in wide  # a pair that carries a vector is not shuffled again
