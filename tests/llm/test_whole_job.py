"""Cases where less than the whole job was done before."""

from __future__ import annotations

import random

import numpy as np
import pytest
from test_odd_input import brute_ppm

from tracewright.llm import decontaminate, language_id, minhash_dedup, ppm, substring_dedup


def test_repeated_rows_stay_once_and_keep_their_text(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(f"u{rng.randint(0, 10**9)}" for _ in range(n))
    clean, other, copy = text(60), text(50), text(40)
    rows = [(1, clean), (1, clean), (2, other), (2, other + " tail"), (3, copy), (4, copy), (4, copy), (5, None), (5, None), (None, text(40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = minhash_dedup.keep_one_of_each(docs)
    key = lambda r: (r[0] or 0, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == sorted([(1, clean), (2, other), (3, copy), (5, None), rows[-1]], key=key)
    cut = substring_dedup.remove_repeats(kept)
    assert {r.doc_id: r.text for r in cut.collect()}[1] == clean


def test_only_contaminated_rows_go(spark):
    item = " ".join(f"q{i}" for i in range(40))
    rows = [(None, item), (None, "clean text without an id"), (None, None), (1, "before " + item), (1, "clean text under the same id"), (2, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {(r.doc_id, r.text) for r in left.collect()} == {rows[1], rows[2], rows[4], rows[5]}


def test_items_with_swapped_halves(spark):
    words = [f"q{i}" for i in range(60)]
    pad = [f"p{i}" for i in range(100)]
    swapped = words[30:] + words[:30]
    texts = [pad + swapped + pad, swapped, pad + swapped[:55], pad + words[:30] + pad[:30] + words[30:]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    found = {r.doc_id: (r.start_word, r.shared, r.total) for r in decontaminate.find_items(docs, items).collect()}
    assert found == {0: (100, 52, 60), 1: (0, 52, 60), 2: (100, 47, 60)}


@pytest.mark.parametrize("entries", [20, 150, 600])
def test_ppm_scores_do_not_depend_on_the_head(spark, entries):
    rng = random.Random(6)
    text = lambda: "".join(rng.choice(["a", "b", "the ", "ing", "é", " "]) for _ in range(rng.randint(0, 60)))
    learn, ask = [text() for _ in range(30)], [text() + rng.choice(["", "zq"]) for _ in range(40)] + ["", "unseen!"]
    frame = lambda ts: spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")
    found = {r.doc_id: r.score for r in ppm.score_texts(frame(ask), frame(learn), entries=entries, head=5).collect()}
    want = brute_ppm([t.encode() for t in learn], [t.encode() for t in ask], ppm.ORDER)
    assert max(abs(found[i] - w) for i, w in enumerate(want)) < 1e-4


def test_a_large_language_takes_no_words_from_a_small_one(spark):
    big = [f"big{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]
    small = [f"few{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(big * 9 + ["both"] * 100), "en"), (" ".join([*small, "both"]), "xx")]
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"), words=30, grams=100)
    assert set(small) <= set(model.words)
    total = np.array([400 * 9 + 100, 21])
    want = np.log((np.array([100, 1]) + 0.5) / (total + 0.5 * (len(model.words) + 1)))
    assert np.allclose(model.word_logs[model.words.index("both")], want, atol=1e-4)
    assert set(language_id.gram_codes(small, 4)[1].tolist()) <= set(model.gram_codes[0].tolist())


@pytest.mark.parametrize("width", [1, 2, 3, 7, 8, 28])
def test_sliding_argmin(width):
    values = np.random.default_rng(width).integers(0, 9, 200).astype(np.uint64)
    want = [i + int(values[i : i + width].argmin()) for i in range(200 - width + 1)]
    assert substring_dedup.sliding_argmin(values, width).tolist() == want
