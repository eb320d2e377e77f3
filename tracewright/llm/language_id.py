"""Language of whole texts: known words by log frequency, unknown words by the longest character n-grams that are known.

A word is a run of letters (Unicode category L) with the marks that follow them (M), lower-cased. Counts of words by language cover all training texts. The ``WORDS`` most frequent
words of each language form the table of known words; the n-grams (4, 3, 2 and 1 characters) of all counted words, space-padded,
form the tables for the rest, the ``GRAMS`` most frequent of each length and language. What is chosen in one language has its counts in all. Each known word adds its smoothed log frequency in every language. An
unknown word adds the mean over its n-grams of the greatest length of which any is known. The language with the largest
sum wins (ties: the smaller name); the score is its share after spreading the sums over the square root of the word count.

Texts that are null or have no letter get ``und`` with score 0, and so does every text when nothing can be learned. Ids may be
null (never held out) or repeat. Only text and language of training rows are read; ids only choose the rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.base import Workspace, bucket, packed, query, table

WORDS = 50_000
GRAMS = 1 << 16
LENGTHS = (4, 3, 2, 1)
SMOOTH = 0.5
#: Below U+0300 there are no marks, and only these six characters are word characters for ``re`` but neither digits nor letters.
_FAST = re.compile(r"[^\W\d_]+").findall
_RARE = re.compile("[\xb2\xb3\xb9\xbc-\xbe\u0300-\U0010ffff]").search
_FULL = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall
_HELD = 200_000


def words_of(text: str) -> list[str]:
    return _FULL(text) if _RARE(text) else _FAST(text)


@dataclass
class Model:
    languages: list[str]
    words: list[str]
    word_logs: np.ndarray
    gram_codes: list[np.ndarray]
    gram_logs: list[np.ndarray]
    rows: dict[str, int] = field(default_factory=dict)

    def known(self) -> dict[str, int]:
        if not self.rows:
            self.rows = {w: i for i, w in enumerate(self.words)}
        return self.rows


def gram_codes(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, code) of all n-grams of the padded words; a code packs the low 16 bits of each character."""
    points = np.frombuffer(" ".join(["", *words, ""]).encode("utf-32-le"), np.uint32).astype(np.uint64) & np.uint64(0xFFFF)
    code = np.zeros(max(len(points) - n + 1, 0), np.uint64)
    for i in range(n):
        code = (code << np.uint64(16)) | points[i : i + len(code)]
    # the space before word w is at begin[w]; the one after it belongs to both neighbours
    begin = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words])))
    start = np.arange(len(code))
    word = np.searchsorted(begin, start, "right") - 1
    inside = (word < len(words)) & (start + n - 1 <= begin[np.minimum(word + 1, len(begin) - 1)])
    return word[inside], code[inside]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = defaultdict(Counter)

    def rows():
        for lang, words in counts.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(words)), pa.array(list(words)), pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"]
            )
        counts.clear()

    for batch in (b for big in batches for b in packed([big], "text", 2 << 20)):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            counts[lang].update(words_of(text.lower()))
        if sum(map(len, counts.values())) > _HELD:
            yield from rows()
    yield from rows()


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
        for lang in np.unique(langs.astype(str)):
            own = np.flatnonzero(langs == lang)
            for size in LENGTHS:
                word, code = gram_codes([words[i] for i in own], size)
                distinct, at = np.unique(code, return_inverse=True)
                total = np.bincount(at, weights=n[own][word]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(distinct)), pa.array(np.full(len(distinct), size, np.int32)), pa.array(distinct.view(np.int64)), pa.array(total)],
                    names=["lang", "size", "code", "n"],
                )


def _logs(keys: np.ndarray, langs: np.ndarray, n: np.ndarray, totals: dict[str, int], languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys, and for each of them the smoothed log frequency in every language."""
    distinct, row = np.unique(keys, return_inverse=True)
    counts = np.zeros((len(distinct), len(languages)))
    counts[row, [languages.index(x) for x in langs]] = n
    total = np.array([totals.get(x, 0) for x in languages], float)
    return distinct, np.log((counts + SMOOTH) / (total + SMOOTH * (len(distinct) + 1))).astype(np.float32)


def train(rows: DataFrame, words: int = WORDS, grams: int = GRAMS) -> Model | None:
    """The model of rows (text, lang); both must be there."""
    spark = rows.sparkSession
    ws = Workspace(spark, "language")
    counted = rows.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    counts = counted.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = ws.write(counts, "words")
    gram_counts = counts.mapInArrow(_count_grams, "lang string, size int, code long, n long").groupBy("lang", "size", "code").agg(F.sum("n").alias("n"))
    gram_counts = ws.write(gram_counts, "grams")
    word_total = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).collect()}
    if not word_total:
        ws.close()
        return None
    languages = sorted(word_total)
    gram_total = {(r[0], r[1]): r[2] for r in gram_counts.groupBy("lang", "size").agg(F.sum("n")).collect()}

    def top(df: DataFrame, key: str, most: int):
        """All rows of the keys that are among the most frequent of a language, at most about ``most`` of each: those whose count there
        reaches a threshold of that language. So a chosen key has its counts in every language."""
        level = defaultdict(list)
        for lang, b, c in df.groupBy("lang", F.floor(F.log2("n") * 4).cast("int").alias("b")).count().collect():
            level[lang].append((b, c))
        least = []
        for lang, sizes in level.items():
            limit, kept = 0.0, 0
            for b, c in sorted(sizes, reverse=True):
                if kept and kept + c > most:
                    limit = 2 ** ((b + 1) / 4)
                    break
                kept += c
            least.append((lang, limit))
        limits = spark.createDataFrame(least, "lang string, least double")  # a row for each language
        chosen = ws.write(df.join(F.broadcast(limits), "lang").where("n >= least").select(key).distinct(), "chosen")
        return df.join(chosen, key, "left_semi").toPandas()

    vocabulary = top(counts, "word", words)
    known, word_logs = _logs(vocabulary["word"].to_numpy(str), vocabulary["lang"].to_numpy(), vocabulary["n"].to_numpy(), word_total, languages)
    codes, logs = [], []
    for size in LENGTHS:
        part = top(gram_counts.where(F.col("size") == size), "code", grams)
        c, v = _logs(part["code"].to_numpy(np.int64).view(np.uint64), part["lang"].to_numpy(), part["n"].to_numpy(),
                     {x: gram_total.get((x, size), 0) for x in languages}, languages)
        codes.append(c)
        logs.append(v)
    ws.close()
    return Model(languages, known.tolist(), word_logs, codes, logs)


def _unknown(model: Model, words: list[str]) -> np.ndarray:
    """What each unknown word adds: backs off from the longest n-grams to the shortest."""
    out = np.zeros((len(words), len(model.languages)))
    left = np.arange(len(words))
    for size, codes, logs in zip(LENGTHS, model.gram_codes, model.gram_logs):
        if not len(left):
            break
        word, code = gram_codes([words[i] for i in left], size)
        at = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
        hit = codes[at] == code if len(codes) else np.zeros(len(code), bool)
        word, at = word[hit], at[hit]
        n = np.bincount(word, minlength=len(left))
        for k in range(len(model.languages)):
            out[left[n > 0], k] = np.bincount(word, weights=logs[at, k], minlength=len(left))[n > 0] / n[n > 0]
        left = left[n == 0]
    return out


def _predictor(data):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = data.value
        known = model.known() if model else {}
        for batch in (b for big in batches for b in packed([big], "text", 1 << 20)):
            tokens = [words_of((t or "").lower()) for t in batch.column("text").to_pylist()]
            sizes = np.array([len(t) for t in tokens], np.int64)
            lang, score = ["und"] * len(tokens), np.zeros(len(tokens))
            if model and sizes.sum():
                every = [w for t in tokens for w in t]
                row = np.fromiter((known.get(w, -1) for w in every), np.int64, len(every))
                doc = np.repeat(np.arange(len(tokens)), sizes)
                fresh = np.flatnonzero(row < 0)
                names: dict[str, int] = {}
                which = np.array([names.setdefault(every[i], len(names)) for i in fresh.tolist()], np.int64)
                added = _unknown(model, list(names))
                is_known = row >= 0
                sums = np.zeros((len(tokens), len(model.languages)))
                for k in range(len(model.languages)):
                    sums[:, k] = np.bincount(doc[is_known], weights=model.word_logs[row[is_known], k], minlength=len(tokens))
                    if len(fresh):
                        sums[:, k] += np.bincount(doc[fresh], weights=added[which, k], minlength=len(tokens))
                some = np.flatnonzero(sizes)
                best = sums[some].argmax(axis=1)
                spread = np.exp((sums[some] - sums[some].max(axis=1, keepdims=True)) / np.sqrt(sizes[some])[:, None])
                score[some] = 1 / spread.sum(axis=1)
                for i, b in zip(some.tolist(), best.tolist()):
                    lang[i] = model.languages[b]
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"]
            )

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(every column of ``docs`` but text, lang_pred, score); columns that had the new names are replaced."""
    rest = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    rows = docs.select(F.struct(*rest).alias("row"), docs["text"].cast("string").alias("text"))
    data = docs.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_predictor(data), out).select("row.*", "lang_pred", "score")


@query("op2_language_id")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(bucket(F.col("doc_id"), 5) != 0))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
