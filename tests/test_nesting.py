"""Calls nested under their requests: one aggregation, and the sorted table for requests with very many."""

from __future__ import annotations

import pytest

from tracewright.operators import ledger
from tracewright.operators.ledger import CALL


@pytest.mark.parametrize("most", [10_000, 12])
def test_lists_are_whole_and_in_order(spark, most):
    counts = {1: 1, 2: 5, 3: 6, 4: 12, 5: 13, 6: 40}
    rows = [(100 * k + i, k, "m", i, 1, None) for k, n in counts.items() for i in range(n)] + [(9999, None, "m", 0, 1, None)]
    types = "id long, usage_log_id long, llm_model string, tokens_used long, cost_usd_thousandths long, created_at timestamp"
    calls = spark.createDataFrame(rows, types).repartition(5)
    found: dict = {}
    for r in ledger.call_lists(calls, 5, most).orderBy("usage_log_id", "chunk").collect():
        assert list(r["items"][0].asDict()) == CALL and 1 <= len(r["items"]) <= 5
        assert r["chunk"] == len(found.setdefault(r["usage_log_id"], [])) // 5
        found[r["usage_log_id"]] += [c["id"] for c in r["items"]]
    assert found == {k: [100 * k + i for i in range(n)] for k, n in counts.items()}
