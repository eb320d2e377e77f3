"""Nulls, empty and very long texts, ties, repeated rows, empty tables, other columns with clashing names."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from hashlib import sha256
from math import log10

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from brute import kept_words, tiktoken_rows
from pyspark.sql import functions as F

from tracewright.llm import bpe_tree, chat_format, decontaminate, language_id, minhash_dedup, pivot_search, ppm, substring_dedup, token_counts, toxicity, words
from tracewright.llm.base import Workspace

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def clashing(df):
    for name in ("row", "ka", "kb", "spans", "n", "score", "ids", "pick", "entry", "h", "start", "content"):
        df = df.withColumn(name, F.lit(1))
    return df


def test_words_are_those_of_split():
    rng = random.Random(2)
    texts = [None, "", " a", "a", "b a", "The the", "é \x0b x", "x" * 2_500_000 + " yy", "zz " + "q" * 1_200_000]
    texts += ["".join(rng.choice("ab \n") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    hashes, whose = words.word_hashes(*words.text_bytes(pa.array(texts)), lower=True)
    seen: dict = {}
    for t, a, b in zip(texts, whose, whose[1:]):
        own = (t or "").encode().lower().split()
        assert len(own) == b - a
        assert all(seen.setdefault(w, h) == h for w, h in zip(own, hashes[a:b].tolist()))
    assert len(set(seen.values())) == len(seen)


def test_chat(spark):
    turns = [(1, 2, "assistant", "b<turn>\\"), (1, 0, "user", None), (1, 1, None, "x\n</turn>\n"), (1, 2, "assistant", "b<turn>\\"),
             (None, None, "as\nsistant", "z"), (2, 0, "assistant", "é" * 3_000_000), (2, 1, "assistant", "é" * 3_000_000), (2, 2, "user", "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("p"))
    parts = chat_format.format_chat(df).collect()
    texts = defaultdict(list)
    for p in sorted(parts, key=lambda p: p.part):
        texts[p.conv_id] += chat_format.read_turns(p.formatted.encode())
        for s in p.loss:
            chat_format.unescape(p.formatted.encode()[s.lo : s.hi]).decode()
    assert [(a.decode(), b.decode()) for a, b in texts[1]] == [("user", ""), ("", "x\n</turn>\n"), ("assistant", "b<turn>\\"), ("assistant", "b<turn>\\")]
    assert texts[None] == [(b"as\nsistant", b"z")] and len(texts[2]) == 3 and max(p.part for p in parts) >= 1
    assert chat_format.format_chat(df.limit(0)).count() == 0


def test_language(spark, docs, none):
    model = language_id.train(clashing(docs))
    found = language_id.predict(clashing(docs), model).collect()
    assert len(found) == docs.count() and {r.lang_pred for r in found} <= {"en", "de", "und"}
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (0, 1, 2, 7))
    assert language_id.train(none) is None
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}
    known = spark.createDataFrame([("the cat sat", "en"), ("der hund saß", "de")], "text string, lang string")
    guess = language_id.predict(spark.createDataFrame([(1, "thecat"), (2, "hunde")], "doc_id long, text string"), language_id.train(known))
    assert {r.doc_id: r.lang_pred for r in guess.collect()} == {1: "en", 2: "de"}


def test_token_counts_and_their_cache(spark, docs, rows, none, monkeypatch):
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(file)
    extra = spark.createDataFrame([(90, "a <|endoftext|> B"), (91, "a  b"), (92, " a\tb\n"), (93, "Σας İx ²½"), (94, "x\x1cy")], "doc_id long, text string")
    every = clashing(docs).select("doc_id", "text", "row").unionByName(extra.withColumn("row", F.lit(2)))
    ws = Workspace(spark, "test-cache")
    cache = ws.root + "/cache"
    want = Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in every.collect())
    assert Counter(tuple(r)[:3] for r in token_counts.count_tokens(every, file, cache).collect()) == want
    stored = token_counts.read_cache(spark, cache)
    assert stored.count() == stored.select("content").distinct().count()
    size = stored.count()
    monkeypatch.setattr(token_counts, "_encoder", lambda *a: (lambda batches: (1 / 0 for b in batches if b.num_rows)))  # all found: nothing is encoded
    assert Counter(tuple(r)[:3] for r in token_counts.count_tokens(every, file, cache).collect()) == want
    assert token_counts.read_cache(spark, cache).count() == size
    assert token_counts.count_tokens(none, file, cache).count() == 0
    ws.close()


def near_classes(rows) -> dict:
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        if i is not None:
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[a] < label[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[b], changed = label[a], True
    return {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def test_near_duplicates(spark, docs, rows, none):
    found = minhash_dedup.near_duplicates(clashing(docs)).collect()
    assert {r[0]: tuple(r[1:]) for r in found if r.doc_id is not None} == near_classes(rows)
    assert minhash_dedup.near_duplicates(none).count() == 0
    kept = minhash_dedup.keep_one_of_each(clashing(docs))
    assert kept.columns == clashing(docs).columns and kept.where("doc_id IS NULL").count() == 1


def test_near_duplicates_that_no_star_finds(spark):
    """A chain: neighbours are similar, ends are not; and strays beside a large group."""
    rng = random.Random(4)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(40):
        w = list(base)
        for k in range(i):
            w[k * 3] = f"c{k}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(base[:60] + [f"r{rng.random()}" for _ in range(rng.randint(20, 60))])) for i in range(40)]
    found = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r[0]: tuple(r[1:]) for r in found} == near_classes(rows)


def brute_ppm(train: list[bytes], texts: list[bytes], order: int) -> list[float]:
    seen = [defaultdict(Counter) for _ in range(order + 1)]
    for t in train:
        b = bytes(order) + t
        for i in range(order, len(b)):
            for k in range(order + 1):
                seen[k][b[i - k : i]][b[i]] += 1
    out = []
    for t in texts:
        b, total = bytes(order) + t, 0.0
        for i in range(order, len(b)):
            excluded: set = set()
            for k in range(order, -1, -1):
                c = {s: n for s, n in seen[k].get(b[i - k : i], {}).items() if s not in excluded}
                if not c:
                    continue
                whole = sum(c.values()) + len(c)
                if b[i] in c:
                    total += log10(c[b[i]] / whole)
                    break
                total += log10(len(c) / whole)
                excluded |= set(c)
            else:
                total -= log10(256 - len(excluded))
        out.append(total)
    return out


def test_ppm_is_the_textbook_model(spark, docs, none):
    rng = random.Random(5)
    text = lambda: "".join(rng.choice(["a", "b", "the ", "ing", "é", " "]) for _ in range(rng.randint(0, 60)))
    learn, ask = [text() for _ in range(30)], [text() + rng.choice(["", "zq"]) for _ in range(40)] + ["", "unseen!"]
    frame = lambda ts: spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")
    found = {r.doc_id: r.score for r in ppm.score_texts(frame(ask), frame(learn)).collect()}
    want = brute_ppm([t.encode() for t in learn], [t.encode() for t in ask], ppm.ORDER)
    assert max(abs(found[i] - w) for i, w in enumerate(want)) < 1e-4
    assert ppm.score_texts(clashing(docs), none).agg(F.sum("n_known"), F.max("train_tokens")).first()[:] == (0, 0)
    assert ppm.score_texts(none, docs).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(900)] + [(5000 + i, [0.5] * 8) for i in range(300)]
    rows += [(950, None), (1000, [float("nan")] * 8), (1050, [1.0, None] + [0.0] * 6), (1100, []), (1150, [float("inf")] * 8), (1200, [1.0]), (None, [1.0] * 8), (7, [9.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("ring", F.lit(1)).withColumn("v", F.lit(1))
    good = [(i, np.floor(256 * np.pad(np.array(v, np.float32).astype(float), (0, 8 - len(v))))) for i, v in rows
            if i is not None and v and None not in v and np.isfinite(v).all()]
    want = set()
    for i, q in good:
        if i % 50 == 0:
            best = sorted(((-int(q @ x), j) for j, x in good if j != i))[:5]
            want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    assert {tuple(r) for r in pivot_search.top_k(df).collect()} == want
    assert pivot_search.top_k(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, [1e6, 1e6]), (1, [1e6, 1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in pivot_search.top_k(huge).orderBy("rank").collect()] == [(0, 1, 1, 256**2 * 10**12 + 256**2 * 10**6), (0, 2, 2, 3 * 256**2 * 10**6)]


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(50, 70)] + [(1, None), (None, 1), (50, 1)], "doc_id long, toxic int")
    model = toxicity.train(toxicity.labelled(clashing(docs), labels))
    found = toxicity.score_toxicity(clashing(docs), model)
    assert found.count() == docs.count() and found.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert toxicity.train(toxicity.labelled(none, labels)) is None
    assert toxicity.drop_toxic(clashing(docs), labels.limit(0)).count() == docs.count()
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


@pytest.mark.parametrize("group", [512, 1])
def test_substrings(spark, docs, rows, none, group):
    ws = Workspace(spark, "test")
    spans = substring_dedup.repeated_spans(clashing(docs), ws, 35, group=group)
    found = substring_dedup.with_spans(clashing(docs), spans).select("row.doc_id", "text", "spans").collect()
    want = kept_words([r.text or "" for r in found], 35)
    for r, (n, kept) in zip(found, want):
        assert substring_dedup.keep_words(r.text, r.spans) == (kept, n)
    cut = substring_dedup.remove_repeats(clashing(docs))
    assert cut.columns == clashing(docs).columns and cut.count() == docs.count()
    assert substring_dedup.remove_repeats(none).count() == 0
    ws.close()


def library_encoder():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_of_any_cut():
    bpe, library = bpe_tree.Bpe.of(open(RANKS, "rb").read(), public_tokenizers.PATTERN), library_encoder()
    rng = random.Random(3)
    bits = ["a", "b", "the", "ing", " ", "  ", "\n", "'", "'re", "'s", "'ll", "5", "é", "日本", "!", "\t", "🙂", " ", "x'l", "r", " the", "\r\n", "²", "\u0301"]
    for _ in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))
        ids = library.encode_ordinary(text)
        assert all(bpe.encode(text, leaf) == ids for leaf in (1, 3, 7, 128)) and bpe.decode(ids) == text.encode()
        for cut in {0, len(text) // 3, len(text)}:
            node = bpe.join(text, len(text), bpe.node(text, 0, cut), bpe.node(text, cut, len(text)))
            assert node.ids == ids and node.cuts[-1] == len(text) and sorted(set(node.cuts)) == node.cuts


def test_tokens_of_one_long_match():
    bpe, library = bpe_tree.Bpe.of(open(RANKS, "rb").read(), public_tokenizers.PATTERN), library_encoder()
    rng = random.Random(4)
    words = ["", "ab" * 3000, "a" * 5000, " " * 3000, "日本語" * 700, "".join(rng.choice("etaoinshrdlu") for _ in range(4000))]
    words += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéßñ") for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    for word in words:
        tokens = library.encode_ordinary(word)
        if word.encode() not in bpe.ranks and len(library._core_bpe.encode_ordinary(word)) and bpe.pattern.fullmatch(word):
            for short in (1, 2, 4, 9):
                assert [bpe.ranks[t] for t in bpe.halves(word.encode(), short)] == tokens
        assert bpe.encode(word) == tokens


def test_short_matches_of_a_batch_are_merged_together(monkeypatch):
    library, rng, one_by_one = library_encoder(), random.Random(5), []
    merged = bpe_tree.Bpe.merged
    monkeypatch.setattr(bpe_tree.Bpe, "merged", lambda self, data: one_by_one.append(data) or merged(self, data))
    monkeypatch.setattr(bpe_tree, "_loaded", {})
    monkeypatch.setattr(bpe_tree, "_KEPT", 2000)  # what was met is forgotten between batches
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß日") for _ in range(rng.randint(1, 5))) for _ in range(6000)]
    texts = ["", None, "the", " ", "🙂" * 9, "x" * 700, *(" ".join(words[i : i + 20]) for i in range(0, len(words), 20))]

    class Sent:
        value = open(RANKS, "rb").read()

    batches = (pa.RecordBatch.from_pydict({"n": list(range(i, i + 51)), "text": texts[i : i + 51]}) for i in range(0, 306, 51))
    out = [r for b in bpe_tree._decoder(Sent, public_tokenizers.PATTERN)(bpe_tree._encoder(Sent, public_tokenizers.PATTERN)(batches)) for r in b.to_pylist()]
    assert [r["n"] for r in out] == list(range(306))
    assert [(r["ids"], r["decoded"]) for r in out] == [(library.encode_ordinary(t or ""), (t or "").encode()) for t in texts]
    assert len(one_by_one) < 500  # of the two long matches; before, each of thousands of short ones


def test_tokens_of_parts(spark, docs, none):
    found = bpe_tree.encode_and_decode(docs, RANKS, public_tokenizers.PATTERN)
    want = Counter((r.doc_id, *tiktoken_rows({0: r.text or ""})[0]) for r in docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found.collect()) == want
    small = bpe_tree.decode(bpe_tree.encode(docs, RANKS, public_tokenizers.PATTERN, part=500), RANKS, public_tokenizers.PATTERN)
    assert Counter((r.row.doc_id, sha256(r.decoded).hexdigest(), len(r.ids)) for r in small.collect()) == Counter((a, d, n) for (a, n, _, d), k in want.items() for _ in range(k))
    assert bpe_tree.encode_and_decode(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_benchmark_items(spark, none):
    words_ = [f"q{i}" for i in range(40)]
    edited = words_[:20] + ["other"] + words_[21:]
    items = spark.createDataFrame([(1, " ".join(words_)), (2, "Short Item"), (3, None), (4, " "), (None, "never seen words here at all")], "item_id long, text string")
    pad = [f"p{i}" for i in range(30)]
    rows = [(1, " ".join(pad + words_ + pad)), (2, " ".join(pad + edited).upper()), (3, " ".join(words_[:36])), (4, " ".join(words_[:20] + pad)), (5, "a short\titem b"),
            (6, None), (7, ""), (8, " ".join(pad * 3000)), (1, " ".join(words_)), (None, " ".join(words_))]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {(r.doc_id, r.item_id): (r.start_word, r.shared, r.total) for r in decontaminate.find_items(docs, items).collect()}
    assert found == {(1, 1): (0, 36, 36), (2, 1): (30, 31, 41), (3, 1): (0, 32, 36), (5, 2): (1, 1, 1), (None, 1): (0, 36, 36)}
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()} == {4, 6, 7, 8}
    assert decontaminate.find_items(docs, items.limit(0)).count() == 0 == decontaminate.find_items(none, items).count()
