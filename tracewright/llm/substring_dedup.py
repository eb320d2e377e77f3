"""Passages that occur more than once, found in prefix-partitioned suffix trees, and their removal.

A window is ``window`` consecutive words of one text. A window is repeated when its word sequence starts anywhere else
too, in the same text or another.

1. Every window picks one of its ``seed``-word runs by smallest hash. The choice depends on the words alone, so equal
   windows pick equally, and neighbouring windows mostly share their pick: about one row for 15 words.
2. Picks are counted. A window whose pick is unique cannot be repeated and goes no further.
3. The rest are suffixes to be put into trees. The picked run is the prefix that deals them out. Up to
   ``group`` picks with one prefix make a memory-sized group; a larger group gets a longer prefix, which here is the
   whole window, as a 128-bit fingerprint: then one node is one key and is only counted, with partial counts in each task.
4. The memory-sized groups are read in key order, many at a time. Nodes of depth 1, 2, 4, 8, ... words get numbers, each
   level from the pairs of the one above it (the naming that builds suffix trees by doubling), down to the window's depth. A
   node of that depth with two leaves or more is a maximal repeat's prefix; its leaves are repeated windows.

No task holds more than its share of picks, one group and one text. Nothing is left to chance but fingerprints of 128 bits.

Equal texts enter the trees once; every window of a text that occurs twice is repeated. So a large group of copies costs one text.

Null texts have no words. Texts shorter than the window lose nothing. Rows given twice count as two texts. Ids may be
null or repeat; only content counts. Other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.base import Workspace, packed, query, table, text_key
from tracewright.llm.words import grams, text_bytes, word_hashes

SEED = 8
GROUP = 512

_PICK = "ka long, kb long, pick long, lo int, hi int"
_SEGMENT = "pick long, hot boolean, ka long, kb long, lo int, segment binary"
_SPAN = "ka long, kb long, lo int, hi int"


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each ``width`` neighbouring values stands (the first of equal ones).

    Minima of 2, 4, 8, ... neighbours come from those of half as many; two overlapping ones make any other width.
    """
    at, have = np.arange(len(values), dtype=np.int32), 1

    def lesser(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[b] < values[a], b, a)

    while have * 2 <= width:
        at, have = lesser(at[:-have], at[have:]), have * 2
    return lesser(at[: len(at) - (width - have)], at[width - have :]) if have < width else at


def _picks(window: int, seed: int):
    width = window - seed + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for big in batches for b in packed([big], "text", 2 << 20)):
            words, whose = word_hashes(*text_bytes(batch.column("text")), lower=False)
            if len(words) < window:
                continue
            sizes = np.diff(whose)
            long = sizes >= window
            mark = np.zeros(len(words) + 1, np.int8)
            mark[whose[:-1][long]] += 1
            mark[(whose[1:] - window + 1)[long]] -= 1
            starts = np.flatnonzero(np.cumsum(mark, dtype=np.int8)[:-1])
            if not len(starts):
                continue
            run_hash = grams(words, seed)
            picked = sliding_argmin(run_hash, width)[starts]
            first = np.flatnonzero(np.concatenate(([True], picked[1:] != picked[:-1])))
            last = np.concatenate((first[1:], [len(starts)])) - 1
            row = np.searchsorted(whose, starts[first], "right") - 1
            base = whose[row]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("ka").take(pa.array(row)),
                    batch.column("kb").take(pa.array(row)),
                    pa.array(run_hash[picked[first]].view(np.int64)),
                    pa.array((starts[first] - base).astype(np.int32)),
                    pa.array((starts[last] - base).astype(np.int32)),
                ],
                names=["ka", "kb", "pick", "lo", "hi"],
            )

    return run


def _segments(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["pick", "hot", "ka", "kb", "lo", "segment"]
        before, told = None, False  # equal texts follow each other
        for batch in (b for big in batches for b in packed([big], "text", 4 << 20)):
            out: list[list] = [[] for _ in names]
            for ka, kb, text, runs in zip(*(batch.column(c).to_pylist() for c in ("ka", "kb", "text", "runs"))):
                if (ka, kb) == before:  # a copy: every window of it is repeated; its words are in the trees already
                    if not told:
                        for column, value in zip(out, (None, False, ka, kb, len(text.encode().split()), None)):
                            column.append(value)
                    told = True
                    continue
                before, told = (ka, kb), False
                words = text.encode().split()
                for r in runs:
                    segment = b" ".join(words[r["lo"] : r["hi"] + window])
                    for column, value in zip(out, (r["pick"], r["hot"], ka, kb, r["lo"], segment)):
                        column.append(value)
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return run


def _spans(rows: np.ndarray, starts: np.ndarray, window: int, ka: pa.Array, kb: pa.Array) -> pa.RecordBatch:
    """Neighbouring starts in one row become one span of words."""
    if len(starts):
        new = np.concatenate(([True], (rows[1:] != rows[:-1]) | (starts[1:] > starts[:-1] + 1)))
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(starts)])) - 1
        rows, lo, hi = rows[first], starts[first], starts[last] + window
    else:
        lo = hi = starts
    take = pa.array(rows.astype(np.int64))
    return pa.RecordBatch.from_arrays(
        [ka.take(take), kb.take(take), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))],
        names=["ka", "kb", "lo", "hi"],
    )


def _name(pairs_of: np.ndarray, step: int) -> np.ndarray:
    """Numbers for the pairs (node at i, node at i + step): equal pairs, equal numbers."""
    pairs = pairs_of[: len(pairs_of) - step] * np.int64(len(pairs_of) + 1) + pairs_of[step:]
    return np.unique(pairs, return_inverse=True)[1].astype(np.int64)


def repeated_starts(segments: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, first word) of all windows in the segments that share their tree node at the window's depth."""
    numbers: dict[bytes, int] = {}
    symbols, sizes = [], []
    for s in segments:
        words = s.split(b" ")
        sizes.append(len(words))
        symbols += [numbers.setdefault(w, len(numbers)) for w in words]
    node, depth = np.array(symbols, np.int64), 1
    while depth * 2 <= window:
        node, depth = _name(node, depth), depth * 2
    if depth < window:
        node = _name(node, window - depth)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    sizes = np.array(sizes)
    row = np.repeat(np.arange(len(sizes)), np.maximum(sizes - window + 1, 0))
    first = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(sizes - window + 1, 0)) - np.maximum(sizes - window + 1, 0), np.maximum(sizes - window + 1, 0))
    leaf = node[begin[row] + first]
    deep = np.bincount(leaf, minlength=1)[leaf] >= 2 if len(leaf) else np.zeros(0, bool)
    return row[deep], first[deep]


def _trees(window: int, size: int = 4 << 20):
    """Reads rows in the order of their prefix; cuts them into loads of whole groups."""

    def solve(load: pa.Table) -> pa.RecordBatch:
        load = load.combine_chunks()
        rows, first = repeated_starts(load.column("segment").to_pylist(), window)
        ka, kb, lo = (load.column(c).combine_chunks() for c in ("ka", "kb", "lo"))
        return _spans(rows, first + lo.to_numpy(zero_copy_only=False)[rows], window, ka, kb)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        total = 0
        for batch in (b for big in batches for b in packed([big], "segment", size)):
            held.append(batch)
            total += batch.nbytes
            picks = batch.column("pick").to_numpy(zero_copy_only=False)
            border = int(np.searchsorted(picks, picks[-1]))  # the last group may go on in the next batch
            if total >= size and (border or (len(held) > 1 and held[-2].column("pick")[-1].as_py() != picks[0])):
                whole, rest = pa.Table.from_batches([*held[:-1], batch.slice(0, border)]), batch.slice(border)
                yield solve(whole)
                held, total = [rest], rest.nbytes
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def _fingerprints(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for big in batches for b in packed([big], "segment", 4 << 20)):
            words, whose = word_hashes(*text_bytes(batch.column("segment")), lower=False)
            count = np.diff(whose) - window + 1
            row = np.repeat(np.arange(batch.num_rows), count)
            first = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            at = whose[row] + first
            take = pa.array(row)
            lo = batch.column("lo").to_numpy(zero_copy_only=False)[row] + first
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(grams(words, window)[at].view(np.int64)),
                    pa.array(grams(words, window, 0x9FB21C651E98DF25)[at].view(np.int64)),
                    batch.column("ka").take(take),
                    batch.column("kb").take(take),
                    pa.array(lo.astype(np.int32)),
                    pa.array((lo + window).astype(np.int32)),
                ],
                names=["f", "g", "ka", "kb", "lo", "hi"],
            )

    return run


def repeated_spans(docs: DataFrame, ws: Workspace, window: int = 35, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """(ka, kb, spans) of every text with a repeated window; spans are [lo, hi) in words, in order, and may overlap."""
    seed = min(seed, window)
    keyed = docs.select(*text_key(docs["text"]), docs["text"].cast("string").alias("text"))
    picks = ws.write(keyed.mapInArrow(_picks(window, seed), _PICK), "picks")
    often = picks.groupBy("pick").count().where("count > 1").select("pick", (F.col("count") > group).alias("hot"))
    again = picks.join(often, "pick").groupBy("ka", "kb").agg(F.collect_set(F.struct("pick", "hot", "lo", "hi")).alias("runs"))
    segments = ws.write(keyed.where("text IS NOT NULL").join(again, ["ka", "kb"]).mapInArrow(_segments(window), _SEGMENT), "segments")
    ws.drop(picks)
    copies = segments.where("segment IS NULL").select("ka", "kb", F.lit(0).alias("lo"), F.col("lo").alias("hi"))
    trees = segments.where("NOT hot AND segment IS NOT NULL").repartition("pick").sortWithinPartitions("pick").mapInArrow(_trees(window), _SPAN)
    nodes = segments.where("hot").mapInArrow(_fingerprints(window), "f long, g long, " + _SPAN)
    shared = nodes.groupBy("f", "g").count().where("count > 1").select("f", "g")
    spans = copies.unionByName(trees).unionByName(nodes.join(shared, ["f", "g"], "left_semi").drop("f", "g"))
    return spans.groupBy("ka", "kb").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))


def keep_words(text: str | None, spans) -> tuple[list[bytes], int]:
    """The words outside the spans, and how many words the text has."""
    words = (text or "").encode().split()
    if spans is None or not len(spans):
        return words, len(words)
    inside = np.zeros(len(words) + 1, np.int32)
    for span in spans:
        inside[span["lo"]] += 1
        inside[span["hi"]] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(inside)[:-1] == 0).tolist()], len(words)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import sha256

    for batch in (b for big in batches for b in packed([big], "text")):
        rows = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            kept, n = keep_words(text, spans)
            rows.append((n, n - len(kept), sha256(b" ".join(kept)).hexdigest()))
        n, removed, sha = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(row, text, spans): every row of docs as a struct beside its spans, null where nothing is repeated."""
    keyed = docs.select(F.struct("*").alias("row"), docs["text"].alias("text"), *text_key(docs["text"]))
    return keyed.join(spans, ["ka", "kb"], "left").select("row", "text", "spans")


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """``docs`` with repeated passages cut out of the text; a text that loses nothing stays as it is.

    All occurrences go. What is left is joined by single spaces; a text may become empty, but its row stays.
    """
    ws = Workspace(docs.sparkSession, "substring-dedup")

    @F.pandas_udf(T.StringType())
    def cut(text, spans):
        import pandas as pd

        return pd.Series(
            [t if s is None else b" ".join(keep_words(t, s)[0]).decode() for t, s in zip(text, spans)], dtype=object
        )

    whole = with_spans(docs, ws.result(repeated_spans(docs, ws, window), "spans"))
    new = F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut("text", "spans"))
    return whole.select(*[new.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


@query("op8_substring_dedup")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    ws = Workspace(spark, "op8")
    spans = repeated_spans(docs, ws)
    rows = with_spans(docs, spans).select(F.col("row.doc_id").alias("doc_id"), "text", "spans")
    schema = T.StructType([docs.schema["doc_id"]]).simpleString()[7:-1].replace(":", " ")
    return ws.result(rows.mapInArrow(_digests, schema + ", n_words long, n_removed long, kept_sha256 string"))
