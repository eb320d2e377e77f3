from __future__ import annotations

import os
import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_texts() -> list[tuple]:
    """Ids and texts: nulls, blanks, ties, repeated rows, near copies, shared passages, long texts, rare characters."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)] + ["été", "Straße", "don't", "x_y", "日本語", "🙂"]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, base = words(60), words(200)
    rows = [(0, None), (1, ""), (2, " \t\n\x0b\f\r "), (3, "one"), (4, "one"), (5, "a b c d"), (6, "A B c D"), (7, "12 345 !!"), (None, "no id here at all")]
    rows += [(10 + i, " ".join(words(30) + passage + words(20))) for i in range(4)]
    rows += [(20 + i, " ".join(base[:k] + ["new"] + base[k:])) for i, k in enumerate((5, 60, 190))]
    rows += [(30, " ".join(base)), (31, "  ".join(base).upper()), (32, " ".join(base))]
    rows += [(40, " ".join(words(30000))), (41, "z" * 70000 + " end"), (42, "ab" * 40000)]
    rows += [(50 + i, " ".join(words(80))) for i in range(20)]
    rows += [(50, rows[-20][1])]  # one row twice
    return rows


@pytest.fixture(scope="session")
def rows():
    return odd_texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    langs = ["en", "de", None]
    full = [(i, t, langs[k % 3], "s", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
