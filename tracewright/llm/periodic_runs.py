"""Periodic runs of words: stretches that repeat with a period, as long as they can be.

A run is a stretch with smallest period q (words q apart are the same) and at least max(``SHORTEST``, ``EXPONENT`` * q) words that no
neighbouring word extends. Runs are maximal pairs: if a run begins at s and has n words, the words from s and from s + q
agree for exactly n - q words, and the words before s and s + q differ. So all runs come from one walk over the tree of common prefixes:

1. Suffixes of each text are sorted with their common prefixes, for whole batches of texts at once (``suffixes``). Suffixes whose first words
   occur once in the text are leaves below the root and take no part.
2. Subtrees all of whose positions have one left word, or none of whose positions are near enough, hold no such pair. They are
   left out by one vectorised test; what remains is little.
3. The intervals of the rest are walked bottom-up. Each keeps its positions in order with their left words; when children meet at depth l, a pair
   across them with different left words and a distance q of at most l / (``EXPONENT`` - 1) is a run of l + q words. No word is
   compared again. Positions nearer than that lie in one stretch, so the next position on each side is the only partner of smallest
   period; smaller lists go into larger ones.

A period that is a multiple of another one of the same stretch is dropped. Texts are read whole; a task holds one batch of about 2 MB, or one text.
Null and empty texts have no runs. Rows that repeat an id are each looked at. Columns of the input stay inside the struct ``row``.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.base import Workspace, packed, query, table
from tracewright.llm.suffixes import suffix_order
from tracewright.llm.words import U, text_bytes, word_hashes

SHORTEST = 6
EXPONENT = 4
_RUNS = "array<struct<start: int, length: int, period: int>>"


def _pairs(places: list[int], shared: list[int], left: list[int], shortest: int, exponent: int) -> Iterator[tuple[int, int, int]]:
    """(place, distance, depth) of the maximal pairs of one subtree that are near enough, bottom-up; ``shared[0]`` is not read."""

    def meet(one: list[int], other: list[int], depth: int) -> list[int]:
        small, large = (one, other) if len(one) < len(other) else (other, one)
        near = depth // (exponent - 1)
        for x in small:
            k = bisect_left(large, x)
            for y in large[max(k - 1, 0) : k + 1]:
                if abs(x - y) <= near and abs(x - y) + depth >= shortest and left[x] != left[y]:
                    found.append((min(x, y), abs(x - y), depth))
        if len(small) == 1:
            insort(large, small[0])
        else:
            large += small
            large.sort()
        return large

    found: list[tuple[int, int, int]] = []
    open_: list[tuple[int, list[int]]] = []  # intervals not yet closed: depth, positions
    last = [places[0]]
    for place, depth in zip(places[1:], shared[1:]):
        while open_ and open_[-1][0] > depth:
            last = meet(open_[-1][1], last, open_.pop()[0])
        if open_ and open_[-1][0] == depth:
            last = meet(open_.pop()[1], last, depth)
        open_.append((depth, last))
        last = [place]
    while open_:
        depth, positions = open_.pop()
        last = meet(positions, last, depth)
    yield from found


def runs_of(words: np.ndarray, whose: np.ndarray, shortest: int = SHORTEST, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (text, start, period, length) of all runs, in that order; ``words`` are hashes, ``whose`` the texts' offsets."""
    if exponent < 3:
        raise ValueError("a run is found by its nearest neighbour only from three periods on")
    sizes = np.diff(whose)
    text = np.repeat(np.arange(len(sizes)), sizes)
    end = whose[1:][text]
    depth = min(max((exponent - 1) * q, shortest - q) for q in range(1, shortest + 1))  # of the shallowest pair that can be a run
    order, shared = suffix_order(words, end, text, depth)
    empty = np.zeros((0, 4), np.int64)
    if not len(order):
        return empty
    begin = np.flatnonzero(shared < depth)  # where subtrees begin
    tree = np.cumsum(shared < depth) - 1
    left = np.where(order > whose[text[order]], words[order - 1] | U(1), U(0))
    by_place = np.lexsort((order, tree))
    gap = np.diff(order[by_place])
    gap[tree[by_place][1:] != tree[by_place][:-1]] = len(words)
    nearest = np.minimum.reduceat(np.append(gap, len(words)), begin)
    deepest = np.maximum.reduceat(shared, begin)
    may = (np.minimum.reduceat(left, begin) != np.maximum.reduceat(left, begin)) & (nearest * (exponent - 1) <= deepest)
    stop = np.append(begin[1:], len(order))
    best: dict[tuple[int, int], int] = {}
    for a, b in zip(begin[may].tolist(), stop[may].tolist()):
        places = order[a:b].tolist()
        for place, period, deep in _pairs(places, shared[a:b].tolist(), dict(zip(places, left[a:b].tolist())), shortest, exponent):
            key = (place, period + deep)
            best[key] = min(period, best.get(key, period))
    if not best:
        return empty
    place, length, period = np.array([(p, n, q) for (p, n), q in best.items()], np.int64).T
    rows = np.stack([text[place], place - whose[text[place]], period, length], axis=1)
    return rows[np.lexsort(rows.T[::-1])]


def _with_runs(shortest: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for big in batches for b in packed([big], "text", 2 << 20)):
            rows = runs_of(*word_hashes(*text_bytes(batch.column("text")), lower=False), shortest, exponent)
            cut = np.searchsorted(rows[:, 0], np.arange(batch.num_rows + 1)).astype(np.int32)
            fields = [pa.array(rows[:, k].astype(np.int32)) for k in (1, 3, 2)]
            runs = pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([*batch.columns, runs], names=[*batch.schema.names, "runs"])

    return run


def kept_words(words: list[bytes], runs: list[dict]) -> list[bytes]:
    """The words that lie in the first period of every run that holds them, or in none."""
    if not runs:
        return words
    inside = np.zeros(len(words) + 1, np.int32)
    for r in runs:
        inside[r["start"] + r["period"]] += 1
        inside[r["start"] + r["length"]] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(inside)[:-1] == 0).tolist()]


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [
            b" ".join(kept_words(t.encode().split(), runs)).decode() if runs else t
            for t, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist())
        ]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), batch.column("runs")], names=["row", "text", "runs"])


def _rows(docs: DataFrame) -> tuple[DataFrame, str]:
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row"), docs["text"].cast("string").alias("text"))
    return rows, f"row {rows.schema['row'].dataType.simpleString()}"


def _steps(*steps):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            batches = step(batches)
        return batches

    return run


def find_runs(docs: DataFrame, shortest: int = SHORTEST, exponent: int = EXPONENT) -> DataFrame:
    """(row, text, runs): every row of ``docs`` but its text as a struct, its text, and its runs by start and period."""
    rows, kind = _rows(docs)
    return rows.mapInArrow(_with_runs(shortest, exponent), f"{kind}, text string, runs {_RUNS}")


def collapse_runs(docs: DataFrame, shortest: int = SHORTEST, exponent: int = EXPONENT) -> DataFrame:
    """Like ``find_runs``, with only the first period of every run left in the text; a text without runs stays as it is."""
    rows, kind = _rows(docs)
    return rows.mapInArrow(_steps(_with_runs(shortest, exponent), _collapsed), f"{kind}, text string, runs {_RUNS}")


def periodic_tail(words: list[bytes], h: int) -> list[bytes]:
    """The query's test case: from word a on, the first p words after it are said again and again (a and p from the hash)."""
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def _with_tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of the ids whose crc32 is divisible by 10 get a periodic tail; a null id has no crc32."""
    for batch in batches:
        hashes = [1 if i is None else zlib.crc32(str(i).encode()) for i in batch.column("row").field("doc_id").to_pylist()]
        texts = batch.column("text").to_pylist()
        for k, (h, t) in enumerate(zip(hashes, texts)):
            if h % 10 == 0 and (words := (t or "").encode().split()):
                texts[k] = b" ".join(periodic_tail(words, h)).decode()
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])


_DIGEST = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
            listed = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in runs)
            longest = min(((-r["length"], r["start"], r["period"]) for r in runs), default=None)
            most = (None,) * 4 if longest is None else (longest[1], -longest[0], longest[2], -1000 * longest[0] // longest[2])
            kept = b" ".join(kept_words((text or "").encode().split(), runs))
            out.append((len(runs), *most, sha256(listed.encode()).hexdigest(), sha256(kept).hexdigest()))
        columns = zip(*out) if out else [()] * 7
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        names = [part.split()[0] for part in _DIGEST.split(", ")]
        yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["row", *names])


_WORD = r"[^\x20\x09-\x0D]+"
#: crc32 of the decimal digits: bit by bit, as DuckDB has no such function; 3988292384 is the polynomial, fixed by crc32.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda s, c: list_reduce(list_prepend(xor(s, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_CRC}, 1) AS h, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS o FROM documents),
e AS (SELECT *, len(o) AS n, (h // 10) % greatest(len(o), 1) AS a FROM d),
f AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM e),
w AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 THEN list_transform(range(n), lambda i: o[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE o END AS ws FROM f),
x AS (SELECT r, n, i, ws[i + 1] AS word, array_to_string(list_slice(ws, i + 1, i + 5), ' ') AS g FROM w, LATERAL (SELECT unnest(range(n)) AS i)),
same AS (SELECT b.r, b.i, c.i - b.i AS q FROM x b JOIN x c ON b.r = c.r AND b.g = c.g AND b.i < c.i AND 4 * (c.i - b.i) <= b.n WHERE c.i + 5 <= c.n),
isle AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS isle FROM same),
runs AS (
  SELECT r, s, length, min(q) AS q FROM (SELECT r, q, min(i) AS s, count(*) + 4 + q AS length FROM isle GROUP BY r, q, isle)
  WHERE length >= greatest(6, 4 * q) GROUP BY r, s, length
), longest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length DESC, s, q) = 1),
listed AS (SELECT r, count(*) AS n_runs, string_agg(concat(s, ',', length, ',', q, chr(10)), '' ORDER BY s, q) AS runs FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, i FROM runs, LATERAL (SELECT unnest(range(s + q, s + length)) AS i)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM x ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, length, q AS period, 1000 * length // q AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM w LEFT JOIN longest USING (r) LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)
"""


@query("op12_periodic_runs", SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    rows, kind = _rows(table(spark, folder, "documents").select("doc_id", "text"))
    ws = Workspace(spark, "op12")
    found = rows.mapInArrow(_steps(_with_tails, _with_runs(SHORTEST, EXPONENT), _digests), f"{kind}, {_DIGEST}")
    return ws.result(found.select("row.doc_id", *(part.split()[0] for part in _DIGEST.split(", "))))
