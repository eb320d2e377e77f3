"""Each query against its SQL, or, where SQL can't say it, against a plain computation of the same thing."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import public_tokenizers
import pytest
from brute import any_item, held, kept_words, tiktoken_rows
from compare import compare, duck

import corpus_pipeline
from tracewright.llm.workloads import REGISTRY


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if q.sql))
def test_matches_sql(spark, folder, name):
    assert compare(REGISTRY[name].run(spark, folder), duck(folder), REGISTRY[name].sql) is None


@pytest.fixture(scope="module")
def texts(spark, folder):
    return {r[0]: r[1] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}


def test_op2(spark, folder):
    langs = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect())
    found = REGISTRY["op2_language_id"].run(spark, folder).collect()
    assert {r.doc_id: r.held_out for r in found} == {i: held(i, 5, 0) for i in langs}
    right = [r.lang_pred == langs[r.doc_id] for r in found if r.held_out]
    assert sum(right) >= 0.9 * len(right) and all(0 <= r.score <= 1 for r in found)


def test_op3(spark, folder, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: (len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 2048) for i, t in texts.items()}
    assert {r[0]: tuple(r[1:]) for r in REGISTRY["op3_token_counts"].run(spark, folder).collect()} == want


def test_op5(spark, folder, texts):
    learned = {i: t for i, t in texts.items() if not held(i, 7, 2)}
    counts = Counter(w for t in learned.values() for w in t.encode().lower().split())
    n, v = sum(counts.values()) + len(learned), len(counts) + 1
    for r in REGISTRY["op5_ppm_scores"].run(spark, folder).collect():
        words = texts[r.doc_id].encode().lower().split()
        base = sum(math.log10((c + 1) / (n + v + 1)) for c in [*(counts[w] for w in words), len(learned)])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id, 7, 2), len(words) + 1, 1 + sum(w in counts for w in words), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score <= 0


def test_op7(spark, folder, texts):
    labels = dict(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic").collect())
    found = REGISTRY["op7_toxicity"].run(spark, folder).collect()
    assert len(found) == len(texts)
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == held(r.doc_id, 4, 2)
    score = lambda k: [r.score for r in found if labels.get(r.doc_id) == k]
    assert sum(score(1)) / len(score(1)) > sum(score(0)) / len(score(0))


def test_op8(spark, folder, texts):
    ids = list(texts)
    want = {i: (n, n - len(k), hashlib.sha256(b" ".join(k)).hexdigest()) for i, (n, k) in zip(ids, kept_words([texts[i] for i in ids], 35))}
    assert {r[0]: tuple(r[1:]) for r in REGISTRY["op8_substring_dedup"].run(spark, folder).collect()} == want


def test_op9(spark, folder, texts):
    found = REGISTRY["op9_bpe_tree"].run(spark, folder).collect()
    assert {r[0]: tuple(r[1:]) for r in found} == tiktoken_rows(texts)


def test_pipeline(spark, folder, texts):
    """Each stage against a plain computation on its own input."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        kept[name] = {r.doc_id: r for r in out.collect()}
        if name != "encoding":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(list(kept[name].values()), docs.schema)
    scored = {r.doc_id for r in REGISTRY["op7_toxicity"].run(spark, folder).where("predicted = 0").collect()}
    assert set(kept["toxicity"]) == scored
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (r.text or "").encode().lower().split()) else set() for i, r in kept["toxicity"].items()}
    gone = set(shingles) - set(kept["near_duplicates"])
    near = lambda a, b: 100 * len(a & b) >= 75 * len(a | b) and bool(a)
    assert all(any(near(shingles[i], shingles[j]) for j in shingles if j < i) for i in gone)
    left = sorted(kept["near_duplicates"])
    assert not any(near(shingles[i], shingles[j]) for n, i in enumerate(left) for j in left[:n])
    cut = kept_words([kept["near_duplicates"][i].text or "" for i in left], 35)
    for i, (n, words) in zip(left, cut):
        r = kept["substrings"][i]
        assert r.text == (kept["near_duplicates"][i].text if n == len(words) else b" ".join(words).decode()) and r.n_chars == len(r.text)
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = {i for i, r in kept["substrings"].items() if not any_item(r.text, items)}
    assert set(kept["decontamination"]) == clean and {kept["substrings"][i].text for i in clean} == {r.text for r in kept["decontamination"].values()}
    want = tiktoken_rows({i: r.text or "" for i, r in kept["decontamination"].items()})
    assert {i: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for i, r in kept["encoding"].items()} == want


def test_run_and_registry(spark, folder):
    import __spark_entry__ as registered

    names = [n for n in registered.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in registered.queries()
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_pipeline_on_odd_input(spark, docs, none, folder):
    """Nulls, blanks, long texts, repeated rows and ids, clashing names, and no rows at all."""
    from pyspark.sql import functions as F

    names = ("_tw_text", "row", "spans", "ka", "kb", "score", "predicted", "ids", "n_tokens", "pick", "doc", "item_id")
    now = docs
    for name in names:
        now = now.withColumn(name, F.lit("mine"))
    columns = now.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, folder)
        rows = now.collect()
        if name != "encoding":
            assert now.columns == columns and all(r[c] == "mine" for r in rows for c in names)
            now = spark.createDataFrame(rows, now.schema)
        kept[name] = rows
    last = {r.doc_id: r for r in kept["encoding"]}
    assert set(names) - {"n_tokens"} <= set(kept["encoding"][0].asDict()) and "text" not in kept["encoding"][0].asDict()
    assert last[0].n_tokens == last[1].n_tokens == 0 and last[2].n_tokens > 0
    assert sum(r.doc_id == 50 for r in kept["near_duplicates"]) == 1 and {3, 5} <= set(last) and not {4, 6} & set(last)
    empty = none
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, folder)
        assert empty.count() == 0
