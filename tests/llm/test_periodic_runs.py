"""Periodic runs against every period tried at every place, and odd input."""

from __future__ import annotations

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import periodic_runs, suffixes


def plain_runs(w: list, shortest: int, exponent: int) -> list[tuple[int, int, int]]:
    found: dict = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if (n := i - s + q) >= max(shortest, exponent * q) and i > s:
                found[s, n] = min(q, found.get((s, n), q))
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def some_words(rng: random.Random) -> list[int]:
    k, w = rng.choice([1, 2, 3, 5]), []
    for _ in range(rng.randint(0, 6)):
        if rng.random() < 0.5:
            w += [rng.randint(1, k) for _ in range(rng.randint(0, 15))]
        else:
            w += ([rng.randint(1, k) for _ in range(rng.randint(1, 5))] * 12)[: rng.randint(1, 40)]
    return w


def hashed(texts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.array([x for t in texts for x in t], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return flat, np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


@pytest.mark.parametrize("shortest, exponent", [(6, 4), (4, 3), (9, 3), (1, 5)])
def test_runs_are_all_runs(shortest, exponent):
    rng = random.Random(shortest)
    for _ in range(300):
        texts = [some_words(rng) for _ in range(rng.randint(1, 5))]
        want = [(i, s, q, n) for i, t in enumerate(texts) for s, n, q in sorted(plain_runs(t, shortest, exponent), key=lambda r: (r[0], r[2]))]
        assert list(map(tuple, periodic_runs.runs_of(*hashed(texts), shortest, exponent).tolist())) == want


def test_suffixes_and_their_common_prefixes():
    rng = random.Random(3)
    for _ in range(200):
        texts = [some_words(rng) for _ in range(rng.randint(1, 4))]
        groups = [rng.randint(0, 1) for _ in texts]
        words, whose = hashed(texts)
        owner = np.repeat(np.arange(len(texts)), np.diff(whose))
        order, shared = suffixes.suffix_order(words, whose[1:][owner], np.array(groups)[owner], 3)
        spot = {(owner[p], p - whose[owner[p]]): k for k, p in enumerate(order.tolist())}

        def common(a, b):
            x, y = texts[a[0]][a[1] :], texts[b[0]][b[1] :]
            return next((n for n, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))

        every = [(i, k) for i, t in enumerate(texts) for k in range(len(t))]
        for n, a in enumerate(every):
            for b in every[:n]:
                if groups[a[0]] == groups[b[0]] and (c := common(a, b)) >= 3:
                    lo, hi = sorted((spot[a], spot[b]))
                    assert shared[lo + 1 : hi + 1].min() == c


def test_one_very_long_run_takes_no_square_time():
    begin = time.perf_counter()
    for period in (1, 2, 1000):
        words, whose = hashed([list(range(period)) * (100_000 // period)])
        assert periodic_runs.runs_of(words, whose).tolist() == [[0, 0, period, 100_000]]
    assert time.perf_counter() - begin < 60


def test_odd_input(spark, docs, none):
    extra = [(200, "a b " * 9 + "c"), (201, "x " * 5), (202, "x " * 6), (203, "no  \n run\there"), (204, "é é é é é é ß"), (None, "z z z z z z z")]
    frame = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    for name in ("row", "runs", "start", "length", "period"):
        frame = frame.withColumn(name, F.lit("x"))
    found = periodic_runs.find_runs(frame).collect()
    assert len(found) == frame.count()
    for r in found:
        assert [(x.start, x.length, x.period) for x in r.runs] == plain_runs((r.text or "").encode().split()[:5000], 6, 4)
    texts = Counter((r.row.doc_id, r.text) for r in periodic_runs.collapse_runs(frame).collect())
    assert {(200, "a b c"), (201, "x " * 5), (202, "x"), (203, "no  \n run\there"), (204, "é ß"), (None, "z"), (0, None), (1, "")} <= set(texts)
    assert periodic_runs.find_runs(none).count() == 0
