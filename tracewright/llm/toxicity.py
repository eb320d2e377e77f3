"""Toxicity scores: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios.

The classifier learns from about ``SAMPLE`` labelled rows: ids are taken by hash, their short list is broadcast after it was counted, and
only their texts leave the scan, so no text is shuffled for a label. Features are the n-grams of 4 and 5 characters (A-Z lower-cased) that a text
contains, hashed into ``BUCKETS``. The sampled rows with each bucket are counted by class; the log ratio of the smoothed
rates is the feature's scale. Buckets whose chi-squared is at least ``LEAST`` (the best ``FEATURES`` of them) enter a logistic regression
with an L2 penalty. The model is a few tables of fixed size; every row is scored by it.

Several labels for one id: toxic if any says so. Null labels and labels of unknown ids are ignored. Null and empty texts
get the score of a text without any feature. Without a training row of either class all scores are 0. Rows that repeat an id are
each scored; if they make the sample larger than asked, it is thinned by hash of the row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.base import bucket, packed, query, table
from tracewright.llm.words import _BASE, _INVERSE, _LOWER, U, mix, powers, text_bytes

SIZES = (4, 5)
BUCKETS = 1 << 18
FEATURES = 1 << 13
#: Least chi-squared of a feature: among 262,144 buckets without any tie to the class, fewer than one gets there.
LEAST = 24.0
SAMPLE = 20_000
PENALTY = 1e-4
THRESHOLD = 0.3
_PIECE = 1 << 20


@dataclass
class Model:
    weight: np.ndarray  # of each bucket; 0 for those that are no features
    bias: float


def slots_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of the character n-grams of all texts, one size and one piece of the bytes after the other.

    Within what one step gives, texts are in order. Pieces keep a long text from costing more memory.
    """
    data, offsets = text_bytes(column)
    for first in range(0, len(data), _PIECE):
        piece = _LOWER[data[first : first + _PIECE + 4 * max(SIZES)]]  # n-grams may end in the next piece
        last = min(first + _PIECE, len(data))
        text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(np.clip(offsets, first, last)))
        lead = np.append(np.flatnonzero((piece & 0xC0) != 0x80), len(piece))
        begin = lead[: np.searchsorted(lead, last - first)]
        text = text_of[begin]
        total = np.zeros(len(piece) + 1, U)
        np.cumsum((piece.astype(U) + U(1)) * powers(_BASE, len(piece)), out=total[1:])
        back = powers(_INVERSE, len(piece))[begin]
        for size in SIZES:
            n = max(0, min(len(begin), len(lead) - size))
            end = lead[size : size + n]
            fits = np.flatnonzero(end + first <= offsets[text[:n] + 1])
            code = (total[end[fits]] - total[begin[fits]]) * back[fits] + U(size)
            yield text[fits], (mix(code) >> U(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def present(column: pa.Array, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every feature that occurs in a text, once each, in that order; ``number`` is -1 for other buckets."""
    pairs = [np.zeros(0, np.int64)]
    for text, slot in slots_of(column):
        feature = number[slot]
        hit = np.flatnonzero(feature >= 0)
        pairs.append(text[hit] * BUCKETS + feature[hit])
    both = np.unique(np.concatenate(pairs))
    return both // BUCKETS, both % BUCKETS


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS), np.int64)
    rows = np.zeros(2, np.int64)
    seen = np.zeros(BUCKETS, bool)
    for batch in (b for big in batches for b in packed([big], "text", 1 << 20)):
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        rows += np.bincount(toxic, minlength=2)
        steps = list(slots_of(batch.column("text")))
        cuts = [np.searchsorted(text, np.arange(batch.num_rows + 1)).tolist() for text, _ in steps]
        for i, label in enumerate(toxic.tolist()):
            for (_, slot), cut in zip(steps, cuts):
                seen[slot[cut[i] : cut[i + 1]]] = True
            there = np.flatnonzero(seen)
            counts[label, there] += 1
            seen[there] = False
    slots = np.flatnonzero(counts.sum(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(slots, -1).astype(np.int32)), *(pa.array(np.append(counts[c, slots], rows[c])) for c in (0, 1))],
        names=["slot", "clean", "toxic"],
    )


def _features(number: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for big in batches for b in packed([big], "text", 4 << 20)):
            text, feature = present(batch.column("text"), number)
            offsets = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(feature.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), lists], names=["toxic", "features"])

    return run


def _logistic(rows: np.ndarray, columns: np.ndarray, scale: np.ndarray, y: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient steps with momentum and per-weight step sizes (Adam), all rows at each step."""
    n, k = len(y), len(scale)
    w, b = np.ones(k), np.log((y.sum() + 1) / (n - y.sum() + 1))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    x = scale[columns].astype(np.float32)
    for step in range(1, 301):
        z = np.bincount(rows, weights=x * w[columns], minlength=n) + b
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        slope = np.append(np.bincount(columns, weights=x * error[rows], minlength=k) + penalty * w, error.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:k], b - move[k]
    return w, float(b)


def train(rows: DataFrame, features: int = FEATURES, penalty: float = PENALTY) -> Model | None:
    """The model of labelled rows (text, toxic 0/1): a bounded number of them, see ``labelled``."""
    counts = (
        rows.select("text", "toxic").mapInArrow(_class_counts, "slot int, clean long, toxic long")
        .groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    )
    slot, seen = counts["slot"].to_numpy(), counts[["clean", "toxic"]].to_numpy(np.float64)
    total = seen[slot < 0].sum(axis=0)
    slot, seen = slot[slot >= 0], seen[slot >= 0]
    if not len(slot) or not total.min():
        return None
    rate = (seen + 1) / (total + 2)
    ratio = np.log(rate[:, 1] / rate[:, 0])
    both, share = seen.sum(axis=1), total[1] / total.sum()
    tells = (seen[:, 1] - both * share) ** 2 / (both * share * (1 - share))
    best = np.lexsort((slot, -tells))[: min(features, int((tells >= LEAST).sum()))]
    number = np.full(BUCKETS, -1, np.int32)
    number[slot[best]] = np.arange(len(best))
    table_ = rows.select("text", "toxic").mapInArrow(_features(number), "toxic int, features array<int>").toArrow()
    lists = table_.column("features").combine_chunks()
    y = table_.column("toxic").to_numpy().astype(np.float64)
    sizes = np.diff(lists.offsets.to_numpy())
    w, bias = _logistic(np.repeat(np.arange(len(y)), sizes), lists.flatten().to_numpy(), ratio[best], y, penalty)
    weight = np.zeros(BUCKETS)
    weight[slot[best]] = w * ratio[best]
    return Model(weight, bias)


def _scorer(data):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = data.value
        number = None
        if model is not None:
            used = np.flatnonzero(model.weight)
            number = np.full(BUCKETS, -1, np.int64)
            number[used] = used
        for batch in (b for big in batches for b in packed([big], "text", 4 << 20)):
            score = np.zeros(batch.num_rows)
            if model is not None:
                text, slot = present(batch.column("text"), number)
                z = np.bincount(text, weights=model.weight[slot], minlength=batch.num_rows) + model.bias
                score = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score)], names=[*keep, "score"])

    return run


def _share(key: Column, rows: int, sample: int) -> Column:
    """True for about ``sample`` of ``rows`` rows, picked by hash."""
    return F.pmod(F.xxhash64(F.lit(77), key), F.lit(1 << 20)) < F.lit(-(-sample * (1 << 20) // max(rows, 1)))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of about ``sample`` rows that may be learned from: labelled, and not held out."""
    marks = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", "toxic").where(bucket(F.col("doc_id"), 4) != 2)
    marks = marks.where(_share(F.col("doc_id"), marks.agg(F.count_distinct("doc_id")).first()[0], sample))
    marks = F.broadcast(marks.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))  # about ``sample`` pairs
    rows = docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text")).join(marks, "doc_id")
    found = docs.select("doc_id").join(marks, "doc_id").count()
    return (rows.where(_share(F.col("text"), found, sample)) if found > 2 * sample else rows).select("text", "toxic")


def score_toxicity(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """(row, score, predicted): every row of ``docs`` as a struct beside its score."""
    spark = docs.sparkSession
    rows = docs.select(F.struct("*").alias("row"), docs["text"].cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    scored = rows.mapInArrow(_scorer(spark.sparkContext.broadcast(model)), f"row {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold; learned from the labels of these very rows."""
    model = train(labelled(docs, labels))
    return score_toxicity(docs, model, threshold).where("predicted = 0").select("row.*")


@query("op7_toxicity")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = train(labelled(docs, table(spark, folder, "labels")))
    # only the id stands beside the text: the text itself need not come back from Python
    ids = docs.select(F.struct("doc_id").alias("row"), "text")
    scored = ids.mapInArrow(_scorer(spark.sparkContext.broadcast(model)), f"row {ids.schema['row'].dataType.simpleString()}, score double")
    return scored.select(
        "row.doc_id", (bucket(F.col("row.doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
