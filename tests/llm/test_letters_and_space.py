"""What counts as a letter for the language, brute-force scores, and white space that a tokenizer keeps."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from tracewright.llm import language_id, token_counts
from tracewright.llm.base import Workspace


def plain_words(text: str) -> list[str]:
    words, now = [], ""
    for c in text:
        kind = unicodedata.category(c)[0]
        if kind == "L" or (kind == "M" and now):
            now += c
        else:
            words, now = words + [now] * bool(now), ""
    return words + [now] * bool(now)


TEXTS = ["½ 12 ²", "a½b x² Ⅷ", "हिन्दी भाषा", "été ́x", "don't_stop 3rd", "ªº", "日本語 テスト", "ß Straße ÆON", "¹¾", ""]


@pytest.mark.parametrize("text", TEXTS)
def test_words_are_letters_with_their_marks(text):
    assert language_id.words_of(text.lower()) == plain_words(text.lower())


def test_texts_without_a_letter_are_und(spark):
    model = language_id.train(spark.createDataFrame([("the cat sat", "en"), ("हिन्दी भाषा", "hi")], "text string, lang string"))
    found = language_id.predict(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), model).collect()
    for r in found:
        assert (r.lang_pred == "und") == (not plain_words(TEXTS[r.doc_id].lower())) and (r.score == 0) == (r.lang_pred == "und")


def test_sums_of_logs(spark):
    """Known words by their frequency; others by the mean of their longest known n-grams. Ties go to the smaller name."""
    rows = [("the cat the dog", "en"), ("der hund der katze", "de"), ("le chat", "fr"), (None, "en"), ("no language", None)]
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    counts: dict = defaultdict(Counter)
    for text, lang in rows:
        if text and lang:
            counts[lang].update(plain_words(text))
    langs = sorted(counts)
    vocabulary = set().union(*counts.values())
    grams = {n: {x: Counter() for x in langs} for n in language_id.LENGTHS}

    def cut(word: str, n: int) -> list[str]:
        padded = f" {word} " if n > 1 else f" {word}"  # one space stands between neighbours
        return [padded[i : i + n] for i in range(len(padded) - n + 1)]

    for x in langs:
        for w, k in counts[x].items():
            for n in language_id.LENGTHS:
                for g in cut(w, n):
                    grams[n][x][g] += k

    def log(table: dict, x: str, key: str) -> float:
        kinds = set().union(*table.values())
        return math.log((table[x][key] + language_id.SMOOTH) / (sum(table[x].values()) + language_id.SMOOTH * (len(kinds) + 1)))

    def added(word: str, x: str) -> float:
        if word in vocabulary:
            return log(counts, x, word)
        for n in language_id.LENGTHS:
            known = [g for g in cut(word, n) if any(grams[n][y][g] for y in langs)]
            if known:
                return sum(log(grams[n], x, g) for g in known) / len(known)
        return 0.0

    asked = ["the hund", "cats and dogs", "katzen", "chaton", "xyz", "der le the", "qqq", "cat " * 500]
    found = language_id.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()
    for r in found:
        words = asked[r.doc_id].split()
        sums = {x: sum(added(w, x) for w in words) for x in langs}
        best = max(langs, key=lambda x: (round(sums[x], 5), -langs.index(x)))
        spread = sum(math.exp((s - sums[best]) / math.sqrt(len(words))) for s in sums.values())
        assert r.lang_pred == best and math.isclose(r.score, 1 / spread, rel_tol=1e-3)


def test_white_space_counts_where_the_tokenizer_keeps_it(spark):
    from tokenizers import Tokenizer

    texts = ["a b", "a    b", " a b\n\n", "a\tb", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name, rows in (("byte_bpe_50k.json", 5), ("word_bpe_49k.json", 2)):
        file = public_tokenizers.path(name)
        library = Tokenizer.from_file(file)
        ws = Workspace(spark, "test")
        for _ in range(2):
            found = token_counts.count_tokens(docs, file, ws.root + "/cache").collect()
            assert {r.doc_id: r.n_tokens for r in found} == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
        assert token_counts.read_cache(spark, ws.root + "/cache").count() == rows
        ws.close()
