"""Scores of the toxicity classifier against a plain computation of the same model, and its use of rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tracewright.llm import toxicity


def grams(text: str | None) -> set[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return {low[i : i + n] for n in (4, 5) for i in range(len(low) - n + 1)}


def bucket_of(gram: str) -> int:
    steps = [slot.tolist() for _, slot in toxicity.slots_of(pa.array([gram]))]
    return steps[toxicity.SIZES.index(len(gram))][0]


def buckets(text: str | None, known: dict) -> set[int]:
    for g in grams(text) - set(known):
        known[g] = bucket_of(g)
    return {known[g] for g in grams(text)}


def test_grams_are_of_characters(monkeypatch):
    texts = [None, "", "abc", "abcd", "Straßen ÄÖÜ", "日本語のテキスト", "🙂" * 9, "aé" * 40]
    for piece in (1 << 20, 16, 7):
        monkeypatch.setattr(toxicity, "_PIECE", piece)
        slots: list[set] = [set() for _ in texts]
        for text, slot in toxicity.slots_of(pa.array(texts, pa.string())):
            assert (np.diff(text) >= 0).all()
            for t, s in zip(text.tolist(), slot.tolist()):
                slots[t].add(s)
        assert [len(s) for s in slots] == [len(grams(t)) for t in texts]
        one = [{s for _, slot in toxicity.slots_of(pa.array([t], pa.string())) for s in slot.tolist()} for t in texts]
        assert one == slots


def plain_scores(train: list[tuple[str, int]], asked: list[str | None]) -> list[float]:
    known: dict = {}
    sets, y = [buckets(t, known) for t, _ in train], np.array([k for _, k in train], float)
    n, bad = len(y), y.sum()
    chosen, ratio = [], []
    for g in sorted(set().union(*sets)):
        has = np.array([g in s for s in sets])
        clean, toxic = float((has & (y == 0)).sum()), float((has & (y == 1)).sum())
        both, share = clean + toxic, bad / n
        if (toxic - both * share) ** 2 / (both * share * (1 - share)) >= toxicity.LEAST:
            chosen.append(g)
            ratio.append(math.log((toxic + 1) / (bad + 2) / ((clean + 1) / (n - bad + 2))))
    scale = np.array(ratio)
    x = np.array([[g in s for g in chosen] for s in sets]) * scale
    w, b = np.ones(len(scale)), math.log((bad + 1) / (n - bad + 1))
    m, v = np.zeros(len(scale) + 1), np.zeros(len(scale) + 1)
    for step in range(1, 301):
        error = (1 / (1 + np.exp(-(x @ w + b))) - y) / n
        slope = np.append(x.T @ error + toxicity.PENALTY * w, error.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return [1 / (1 + math.exp(-(sum(c * r for g, c, r in zip(chosen, w, ratio) if g in have) + b))) for have in (buckets(t, known) for t in asked)]


@pytest.fixture(scope="module")
def labelled_rows():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeéß日") for _ in range(rng.randint(2, 6)))
    rows = []
    for i in range(240):
        words = [word() for _ in range(rng.randint(3, 30))]
        if toxic := int(i % 4 == 0):
            words.insert(rng.randint(0, len(words)), rng.choice(["Scheußlich", "horrid", "日日本本"]))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_scores_are_those_of_the_plain_model(spark, labelled_rows):
    train = spark.createDataFrame([(t, k) for _, t, k in labelled_rows], "text string, toxic int")
    asked = [t for _, t, _ in labelled_rows[:40]] + [None, "", "abc", "HORRID", "scheußlich " * 3000]
    model = toxicity.train(train)
    frame = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    found = {r.row.doc_id: r.score for r in toxicity.score_toxicity(frame, model).collect()}
    want = plain_scores([(t, k) for _, t, k in labelled_rows], asked)
    assert max(abs(found[i] - w) for i, w in enumerate(want)) < 1e-4
    assert found[40] == found[41] == found[42] and found[43] > 0.5 and found[44] > 0.5


def test_a_repeated_id_does_not_swell_the_sample(spark):
    rows = [(1, f"hot row {i}") for i in range(900)] + [(10 + i, f"other row {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 1), (1, 0)] + [(10 + i, i % 2) for i in range(300)], "doc_id long, toxic int")
    some = toxicity.labelled(docs, labels, sample=100).count()
    assert 40 <= some <= 250
    assert toxicity.score_toxicity(docs, toxicity.train(toxicity.labelled(docs, labels))).count() == 1200
    assert "SortMergeJoin" not in toxicity.labelled(docs, labels)._jdf.queryExecution().toString()
