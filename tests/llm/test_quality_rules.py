"""Measures, exact bounds and certified cutoffs of the quality rules."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from compare import compare, duck
from pyspark.sql import functions as F

from tracewright.llm import quality_rules as rules
from tracewright.llm.base import Workspace


def plain(text: str | None) -> tuple:
    t = text or ""
    words = t.encode().split()
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(runs)
    again = {i + k for i, r in enumerate(runs) if often[r] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    chars = sum(len(w.decode()) for w in words)
    return len(words), chars, sum(t.count(c) for c in rules.SYMBOLS), len(lines), len(lines) - len(set(lines)), len(again)


def test_measures(spark, docs, none):
    odd = [(100, "a\n a\na\n\n \na"), (101, "x " * 50), (102, "one two three four five\none two three four five #*$%&|<>"), (103, "é 日本 ✓\u0085 x\xa0y"), (104, "\x1c #\x0b|")]
    frame = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"), allowMissingColumns=True)
    for name in ("row", "n_words", "kept", "rule"):
        frame = frame.withColumn(name, F.lit("x"))
    found = rules.measure(frame)
    texts = Counter((r.doc_id, plain(r.text)) for r in frame.collect())
    assert Counter((r.row.doc_id, tuple(r[m] for m in rules.MEASURES)) for r in found.collect()) == texts
    assert rules.measure(none).count() == 0
    ws = Workspace(spark, "test")
    labels = spark.createDataFrame([(1, None), (None, 0), (50, 1), (50, 0), (99999, 0)], "doc_id long, quality int")
    judged = rules.apply_rules(frame, labels, ws).collect()
    assert len(judged) == frame.count() and all(r.kept != r.base_failed for r in judged)  # too few labels to certify anything
    assert rules.apply_rules(none, labels.limit(0), ws).count() == 0
    ws.close()


def test_the_bound_is_exact():
    for n, p in ((1, 0.3), (40, 0.01), (300, 0.05), (2000, 0.01)):
        for k in range(0, math.ceil(n * p)):
            want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert math.isclose(rules.binomial_tail(k, n, p), want, rel_tol=1e-9)
    assert rules.binomial_tail(3, 300, 0.01) == 1.0


@pytest.fixture(scope="module")
def labelled_folder(spark, tmp_path_factory, folder):
    """Three strata: one with many labels (null lang), one with some, one with hardly any; bad rows hold symbols or copied lines."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))
    rows, labels = [], []
    for i in range(3000):
        lang = None if i < 2000 else "xx" if i < 2950 else "yy"
        lines = [" ".join(word() for _ in range(6)) for _ in range(rng.randint(2, 8))]
        bad = rng.random() < 0.2
        if bad and rng.random() < 0.7:
            lines = [x.replace(" ", rng.choice([" | ", "$$ "])) for x in lines]
        elif bad or rng.random() < 0.004:
            lines += [lines[0]] * rng.randint(1, 2)
        rows.append((i, "\n".join(lines), lang))
        if rng.random() < 0.9:
            labels.append((i, 1 - int(bad), 0))
    path = str(tmp_path_factory.mktemp("labelled"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string").toPandas().to_parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").toPandas().to_parquet(f"{path}/labels.parquet")
    for name in "region nation customer supplier part orders lineitem events embeddings pages benchmark conversations".split():
        (tmp_path_factory.getbasetemp() / path / f"{name}.parquet").symlink_to(f"{folder}/{name}.parquet")
    return path


def test_certified_cutoffs(spark, labelled_folder):
    judged = rules.op11(spark, labelled_folder)
    assert compare(judged, duck(labelled_folder), rules.SQL) is None
    measured = rules.measure(spark.read.parquet(f"{labelled_folder}/documents.parquet"))
    cutoffs = {(r.stratum, r.rule): r for r in rules.choose_cutoffs(measured, spark.read.parquet(f"{labelled_folder}/labels.parquet")).collect()}
    assert (None, "symbols") in cutoffs and ("xx", "symbols") in cutoffs and not any(s == "yy" for s, _ in cutoffs)
    walks = 3 * len(rules.RULES)
    for c in cutoffs.values():
        assert rules.binomial_tail(c.good_lost, c.n_good, rules.LIMIT / len(rules.RULES)) <= rules.ERROR / walks
    labels = dict(spark.read.parquet(f"{labelled_folder}/labels.parquet").select("doc_id", "quality").collect())
    out = [r for r in judged.collect() if r.doc_id < 2950 and not r.base_failed and r.doc_id in labels]
    lost = [r for r in out if labels[r.doc_id] == 1 and not r.kept]
    assert len(lost) <= rules.LIMIT * sum(labels[r.doc_id] == 1 for r in out)
    assert sum(not r.kept for r in out if labels[r.doc_id] == 0) > 0.5 * sum(labels[r.doc_id] == 0 for r in out)


def test_many_strata_are_joined_without_broadcast(spark, labelled_folder, monkeypatch):
    want = Counter(map(tuple, rules.op11(spark, labelled_folder).collect()))
    monkeypatch.setattr(rules, "BROADCAST", -1)
    assert Counter(map(tuple, rules.op11(spark, labelled_folder).collect())) == want
