"""Language-model scores of whole texts: prediction by partial matching over bytes, and a unigram baseline over words.

The model is a trie of byte contexts of up to ``ORDER`` bytes, counted over all training texts; a text starts behind
zero bytes. A context that was seen n times with d different next bytes gives byte s the share count(s) / (n + d) and keeps d / (n + d)
for escaping to the context one byte shorter (method C). After an escape the bytes that the longer context knows are
excluded there: their counts and their part of the escape count leave the denominator. Below the empty context stand all bytes not
excluded yet, with equal shares. A text's score is the sum of log10 of its bytes' probabilities.

Counting: one row for each distinct run of ORDER + 1 bytes (a code), with how often it is learned and how often asked for. All contexts of
a byte end in the same bytes, so codes are dealt out once by their last ``SHARED`` context bytes: each task builds the trie of the
contexts it has, from three bytes up, over those of up to two bytes (2^24 entries at the outside), and gives the logarithm of every distinct code
that any text asks for. Hot endings are few distinct codes, however often the texts repeat them.

Scoring: the codes asked for most often (at most ``ENTRIES``, by a threshold from a histogram over the whole corpus) travel with
their logarithms; a byte is one lookup. All other codes, in pieces of bounded length, meet the table of logarithms in an equi-join whose keys are rare
by choice, and its sums are added to the rows. So every score is that of the whole model, whatever the size of the head.

Baseline: log10((c + 1) / (N + V + 1)) for every token, exactly, for any vocabulary: words that reach a count threshold (at most
``HEAD``, from a histogram) are looked up in the task, all other tokens are joined to their counts by hash. Words are 64-bit hashes.

Null texts count as empty: one token (the end), PPM score 0. Ids may be null (never held out) or repeat. No training text: the
trie is empty and every byte costs log10(256); N = V = 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.base import Workspace, bucket, packed, query, table
from tracewright.llm.words import U, mix, text_bytes, word_hashes

ORDER = 6
SHARED = 3
ENTRIES = 1 << 21
HEAD = 1 << 19
_SLICE = 1 << 19
_MERGE = 1 << 20
_KEPT = 1 << 22
_LOAD = 1 << 19
_PIECE = 1 << 16


def codes_of(column: pa.Array, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, code) for slices of all bytes: a code packs a byte and the ``order`` bytes before it, zeros before the start."""
    data, offsets = text_bytes(column)
    for first in range(0, len(data), _SLICE):
        last = min(len(data), first + _SLICE)
        lead = min(first, order)
        piece = data[first - lead : last]
        text = np.searchsorted(offsets, np.arange(first, last), "right") - 1
        place = np.arange(first, last) - offsets[text]
        code = piece[lead:].astype(U)
        for back in range(1, order + 1):
            prior = np.zeros(last - first, U)
            n = len(prior) - max(0, back - lead)
            if n > 0:
                prior[len(prior) - n :] = piece[lead + len(prior) - n - back : lead + len(prior) - back]
            prior[place < back] = 0
            code |= prior << U(8 * back)
        yield text, code


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    n = np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")  # the parts are sorted: this merges them
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n[:0]


def _counted(found: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys and their counts, in order; mostly one row for a key in each task, and never more than ``_KEPT`` keys at once."""
    kept, parts, size = None, [], 0
    for values in found:
        keys, n = np.unique(values, return_counts=True)
        parts.append((keys, n.astype(np.int64)))
        size += len(keys)
        if size > _MERGE:
            kept, parts, size = _merged([*([kept] if kept else []), *parts]), [], 0
            if len(kept[0]) > _KEPT:
                yield kept
                kept = None
    if kept or parts:
        yield _merged([*([kept] if kept else []), *parts])


_COUNTS = "code long, uses long"


def _code_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, uses): how often a code is learned (high half) and asked for (low half); a task has too few bytes for either to overflow."""

    def keys() -> Iterator[np.ndarray]:
        for batch in (b for big in batches for b in packed([big], "text", 4 << 20)):
            use = 2 * batch.column("learn").to_numpy(zero_copy_only=False).astype(np.int64) + batch.column("ask").to_numpy(zero_copy_only=False)
            for text, code in codes_of(batch.column("text"), ORDER):
                yield (code << U(2)) | use.astype(U)[text]

    for key, n in _counted(keys()):  # the lowest two bits of a key are the uses of its text
        use, code = (key & U(3)).astype(np.int64), key >> U(2)
        code, uses = _merged([(code, (n * (use >> 1) << 32) + n * (use & 1))])
        yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(uses)], names=["code", "uses"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = (word_hashes(*text_bytes(b.column("text")), lower=True)[0] for big in batches for b in packed([big], "text", 4 << 20))
    for key, n in _counted(found):
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])


class Lookup:
    """64-bit keys to positions, by open addressing in numpy."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.zeros(1 << self.bits, U)
        waiting, slot = np.arange(len(keys)), self._slot(keys)
        while len(waiting):
            free = np.flatnonzero(self.slots[slot] < 0)
            self.slots[slot[free]] = waiting[free]
            placed = self.slots[slot] == waiting
            self.keys[slot[placed]] = keys[waiting[placed]]
            waiting, slot = waiting[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 if it isn't there."""
        slot = self._slot(keys)
        out = self.slots[slot]
        retry = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        slot = slot[retry]
        while len(retry):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            found = self.slots[slot]
            out[retry] = found
            again = (found >= 0) & (self.keys[slot] != keys[retry])
            retry, slot = retry[again], slot[again]
        return out


def _tag(order: int) -> np.uint64:
    return U(order + 1) << U(56)


class Trie:
    """The context trie with all logarithms a score needs. Entries are (order, context, byte), nodes (order, context)."""

    def __init__(self, order: np.ndarray, code: np.ndarray, count: np.ndarray, top: int):
        """``code`` packs the context's bytes and, lowest, the next byte."""
        self.top = top
        entry = code | ((order + 1).astype(U) << U(56))
        sort = np.argsort(entry)
        order, code, count, entry = order[sort], code[sort], count[sort].astype(float), entry[sort]
        context = (code >> U(8)) | ((order + 1).astype(U) << U(56))
        starts = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(context) else np.zeros(0, np.int64)
        node = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(context))))
        n = np.add.reduceat(count, starts) if len(starts) else np.zeros(0)
        d = np.diff(np.append(starts, len(context))).astype(float)
        self.entries, self.nodes = Lookup(entry), Lookup(context[starts])
        self.log_count = np.log10(count).astype(np.float32)
        self.log_top = (np.log10(count) - np.log10(n + d)[node]).astype(np.float32)
        self.escape_top = np.log10(d / (n + d)).astype(np.float32) if len(n) else np.zeros(0, np.float32)
        # what an escape from each node meets one order down, once the node's own bytes are excluded there
        self.below = np.zeros(len(starts), np.float32)
        self.escape_below = np.full(len(starts), np.nan, np.float32)
        self.left = (256 - d).astype(np.float32)
        for k in range(1, top + 1):
            own = np.flatnonzero(order == k)
            mask = U((1 << (8 * k)) - 1)
            shorter = self.entries.find((code[own] & mask) | _tag(k - 1))
            excluded = np.bincount(node[own], weights=np.where(shorter >= 0, count[shorter], 0), minlength=len(starts))
            which = np.unique(node[own])
            parent = self.nodes.find(((context[starts[which]] & U((1 << 56) - 1)) & U((1 << (8 * (k - 1))) - 1)) | _tag(k - 1))
            fresh = d[parent] - d[which]
            whole = n[parent] - excluded[which] + fresh
            open_ = fresh > 0  # else nothing is new one order down, and the escape goes through it for free
            self.below[which[open_]] = np.log10(whole[open_])
            self.escape_below[which[open_]] = np.log10(fresh[open_] / whole[open_])

    def logs(self, code: np.ndarray) -> np.ndarray:
        """log10 of the probability of each byte after its context."""
        out = np.zeros(len(code))
        active = np.arange(len(code))
        child = np.full(len(code), -1)  # the node escaped from
        for k in range(self.top, -1, -1):
            part = code[active] & U((1 << (8 * (k + 1))) - 1)
            entry = self.entries.find(part | _tag(k))
            first = child < 0
            hit = entry >= 0
            top = hit & first
            out[active[top]] += self.log_top[entry[top]]
            low = hit & ~first
            out[active[low]] += self.log_count[entry[low]] - self.below[child[low]]
            miss = ~hit
            active, child, first, part = active[miss], child[miss], first[miss], part[miss]
            if not len(active):
                return out
            node = self.nodes.find((part >> U(8)) | _tag(k))
            there = node >= 0
            new = there & first
            out[active[new]] += self.escape_top[node[new]]
            old = np.flatnonzero(there & ~first)
            step = self.escape_below[child[old]]
            out[active[old]] += np.where(np.isnan(step), 0, step)
            child = np.where(there, node, child)
        left = np.where(child >= 0, self.left[child] if len(self.left) else 256.0, 256.0)
        out[active] -= np.log10(np.maximum(left, 1))
        return out


def _low(code: np.ndarray, order: int) -> np.ndarray:
    return code & U((1 << (8 * (order + 1))) - 1)


def _sums(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _merged([(code, n)])


_LOGS = "code long, asked long, log float"


def _code_logs(data):
    """Reads counts by ending; a load of whole endings, over the short contexts, is a trie that has all contexts of its codes."""

    def solve(load: pa.Table) -> pa.RecordBatch:
        code, learned, asked = (load.column(c).to_numpy() for c in ("code", "learned", "asked"))
        short_code, short_n = data.value
        known = np.flatnonzero(learned)
        orders, codes, counts = [], [], []
        for k in range(ORDER + 1):
            kept, n = (code[known].view(U), learned[known]) if k >= SHARED else (short_code, short_n)
            kept, n = _sums(_low(kept, k), n)
            orders.append(np.full(len(kept), k))
            codes.append(kept)
            counts.append(n)
        trie = Trie(np.concatenate(orders), np.concatenate(codes), np.concatenate(counts), ORDER)
        want = np.flatnonzero(asked)
        logs = np.concatenate([trie.logs(code[want[i : i + _LOAD]].view(U)) for i in range(0, len(want), _LOAD)] or [np.zeros(0)])
        return pa.RecordBatch.from_arrays([pa.array(code[want]), pa.array(asked[want]), pa.array(logs.astype(np.float32))], names=["code", "asked", "log"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            ending = batch.column("ending").to_numpy()
            border = int(np.searchsorted(ending, ending[-1])) if len(ending) else 0  # the last ending may go on in the next batch
            size += batch.num_rows
            if size >= _LOAD and (border or (held and held[-1].column("ending")[-1].as_py() != ending[0])):
                yield solve(pa.Table.from_batches([*held, batch.slice(0, border)]))
                held, size = [batch.slice(border)], batch.num_rows - border
            elif batch.num_rows:
                held.append(batch)
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


@dataclass
class Model:
    code: np.ndarray
    log: np.ndarray
    head: np.ndarray
    head_count: np.ndarray
    tokens: int
    vocabulary: int
    ends: int
    codes: Lookup | None = None
    words: Lookup | None = None

    def ready(self) -> Model:
        """Built once in each Python process."""
        if self.codes is None:
            self.codes, self.words = Lookup(self.code), Lookup(self.head)
        return self


def _threshold(histogram: list, most: int) -> float:
    """Least count kept, so that what is kept comes to ``most`` at the outside; histogram: (log-scale bin, size)."""
    kept, least = 0, 1.0
    for b, size in sorted(((r[0], r[1]) for r in histogram), reverse=True):
        if kept + size > most:
            return 2 ** ((b + 1) / 8)
        kept += size
    return least


def _bin(n):
    return F.floor(F.log2(n) * 8 + 1e-9).cast("int")


def train(rows: DataFrame, ws: Workspace, entries: int = ENTRIES, head: int = HEAD) -> tuple[Model, DataFrame, DataFrame]:
    """The model of the ``rows`` (text, learn, ask) that are learned from, the counts (key, n) of all words and the (code, asked, log) of
    all codes asked for."""
    spark = rows.sparkSession
    ending = F.shiftright("code", 8).bitwiseAND(F.lit((1 << (8 * SHARED)) - 1)).alias("ending")
    learned, asked = F.shiftright("uses", 32), F.col("uses").bitwiseAND(F.lit((1 << 32) - 1))
    counts = rows.select("text", "learn", "ask").mapInArrow(_code_counts, _COUNTS).groupBy("code")
    counts = ws.write(counts.agg(F.sum(learned).alias("learned"), F.sum(asked).alias("asked")), "counts")
    low = F.col("code").bitwiseAND(F.lit((1 << (8 * SHARED)) - 1))  # a byte after up to two bytes
    short = counts.where("learned > 0").groupBy(low.alias("code")).agg(F.sum("learned").alias("n")).toArrow()
    data = spark.sparkContext.broadcast((short.column("code").to_numpy().astype(np.int64).view(U), short.column("n").to_numpy().astype(np.int64)))
    dealt = counts.select(ending, "code", "learned", "asked").repartition("ending").sortWithinPartitions("ending")
    logs = ws.write(dealt.mapInArrow(_code_logs(data), _LOGS), "logs")
    ws.drop(counts)
    texts = rows.where("learn")
    words = ws.write(texts.select("text").mapInArrow(_word_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "words")
    least = _threshold(logs.groupBy(_bin(F.col("asked")).alias("b")).count().collect(), entries)
    often = logs.where(F.col("asked") >= least).select("code", "log").toArrow()
    least = _threshold(words.groupBy(_bin(F.col("n")).alias("b")).count().collect(), head)
    top = words.where(F.col("n") >= least).toArrow()
    tokens, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = texts.count()
    model = Model(
        often.column("code").to_numpy().astype(np.int64).view(U), often.column("log").to_numpy().astype(np.float32),
        top.column("key").to_numpy().astype(np.int64).view(U), top.column("n").to_numpy(), tokens + ends, kinds + bool(ends), ends,
    )
    return model, words, logs


_SCORED = "rid long, doc_id long, n long, known long, logs double, score double, codes array<long>, words array<long>"


def _piece(rid: pa.Array, owner: np.ndarray, values: np.ndarray, name: str) -> pa.RecordBatch:
    """Rows (rid, list) of values by owner (in order), each list of bounded length."""
    begin = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1])))
    begin = np.unique(np.concatenate([begin, np.arange(0, len(owner), _PIECE)]))
    lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(owner)).astype(np.int32)), pa.array(values.view(np.int64)))
    rid = rid.take(pa.array(owner[begin]))
    columns = {"rid": rid, name: lists}
    kinds = {"codes": pa.list_(pa.int64()), "words": pa.list_(pa.int64()), "logs": pa.float64(), "score": pa.float64()}
    names = [part.split()[0] for part in _SCORED.split(", ")]
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(len(begin), kinds.get(c, pa.int64())) for c in names], names=names)


def _scorer(data):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = data.value.ready()
        for batch in (b for big in batches for b in packed([big], "text", 1 << 20)):
            rows, rid = batch.num_rows, batch.column("rid")
            score = np.zeros(rows)
            for text, code in codes_of(batch.column("text"), ORDER):
                at = model.codes.find(code)
                there = at >= 0
                score += np.bincount(text[there], weights=model.log[at[there]], minlength=rows)
                if not there.all():
                    yield _piece(rid, text[~there], code[~there], "codes")
            words, whose = word_hashes(*text_bytes(batch.column("text")), lower=True)
            at = model.words.find(words)
            doc = np.repeat(np.arange(rows), np.diff(whose))
            head = at >= 0
            logs = np.bincount(doc[head], weights=np.log10(model.head_count[at[head]] + 1.0), minlength=rows)
            known = np.bincount(doc[head], minlength=rows) + (model.ends > 0)
            if not head.all():
                yield _piece(rid, doc[~head], words[~head], "words")
            none = pa.nulls(rows, pa.list_(pa.int64()))
            own = (np.diff(whose) + 1, known, logs + np.log10(model.ends + 1.0), score)
            yield pa.RecordBatch.from_arrays([rid, batch.column("doc_id"), *map(pa.array, own), none, none], names=[part.split()[0] for part in _SCORED.split(", ")])

    return run


def score_rows(rows: DataFrame, ws: Workspace, entries: int = ENTRIES, head: int = HEAD) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of the ``rows`` (doc_id, text, learn, ask) that are asked for."""
    rows = rows.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    model, words, logs = train(rows, ws, entries, head)
    data = rows.sparkSession.sparkContext.broadcast(model)
    asked = rows.where("ask").select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = ws.write(asked.mapInArrow(_scorer(data), _SCORED), "scored")
    tail = scored.where("words IS NOT NULL").select("rid", F.explode("words").alias("key"))
    seen = tail.join(words, "key").groupBy("rid").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("more_logs"))
    codes = scored.where("codes IS NOT NULL").select("rid", F.explode("codes").alias("code"))
    rest = codes.join(logs, "code").groupBy("rid").agg(F.sum("log").alias("rest"))
    out = scored.where("n IS NOT NULL").drop("codes", "words").join(seen, "rid", "left").join(rest, "rid", "left")
    whole = float(np.log10(model.tokens + model.vocabulary + 1))
    return ws.result(out.select(
        "doc_id",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n") * F.lit(whole)).alias("base_score"),
        (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"),
    ))


def score_texts(docs: DataFrame, learn: DataFrame, entries: int = ENTRIES, head: int = HEAD) -> DataFrame:
    """Like ``score_rows``, for all ``docs`` (doc_id, text), learned from the texts of another table."""
    asked = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], F.lit(False).alias("learn"), F.lit(True).alias("ask"))
    learned = learn.select(F.lit(None).cast("long").alias("doc_id"), learn["text"], F.lit(True).alias("learn"), F.lit(False).alias("ask"))
    return score_rows(asked.unionByName(learned), Workspace(docs.sparkSession, "ppm"), entries, head)


@query("op5_ppm_scores")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rows = docs.select("doc_id", "text", (bucket(F.col("doc_id"), 7) != 2).alias("learn"), F.lit(True).alias("ask"))
    out = score_rows(rows, Workspace(spark, "op5"))
    return out.withColumn("held_out", bucket(F.col("doc_id"), 7) == 2)
