"""Quality rules whose cutoffs are certified on labelled rows: limited false rejection in every stratum.

Each text is measured once (no shuffle). A rule turns its measures into a whole-number rate; a text fails a rule when its rate reaches
the rule's cutoff in the text's stratum (``lang`` here). Cutoffs are chosen on labelled rows that pass the base test. No rule
is learned from them, so all of them are holdouts:

1. In each (stratum, rule) the labelled rows are counted by rate, rounded down to two decimal digits, and by quality. Counts combine
   map-side, so a hot stratum is a few hundred rows for each task.
2. Candidate cutoffs are tried from the mildest to the strictest. With n good rows, k of them at or above the cutoff, the
   cutoff is certified if P(Binomial(n, limit) <= k) <= level: the exact (Clopper-Pearson) upper bound of the false rejection rate is within
   the limit. The first cutoff that isn't ends the walk, so the order itself pays for testing many cutoffs.
3. All (stratum, rule) walks share one error probability: level = ``ERROR`` / number of walks (Bonferroni). The limit of a rule is ``LIMIT`` /
   number of rules, so the rules of one stratum together keep ``LIMIT``.
4. Among certified cutoffs the one with the highest (share of bad rows caught) - ``COST`` * (share of good rows lost) is taken, the
   mildest of equals; none if that is not above 0.

With a chance of at least 1 - ``ERROR`` every stratum rejects at most ``LIMIT`` of its good rows. A stratum with few labels certifies nothing and
rejects nothing beyond the base test.

Null texts count as empty; they fail the base test (fewer than 10 words). A null stratum is a stratum of its own. Several labels for one
id: bad if any says so; null labels and labels of unknown or null ids are ignored. Rows that repeat an id are each measured and judged, and each
counts. Columns of the input stay inside the struct ``row``, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.base import Workspace, packed, query, table
from tracewright.llm.words import _IS_WORD, U, grams, mix, text_bytes, word_hashes

LIMIT = 0.04
ERROR = 0.05
COST = 10
RUN = 5
BROADCAST = 100_000
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: name: (numerator, denominator, scale); the rate is scale * numerator div denominator
RULES = {
    "symbols": ("n_symbols", "word_chars", 10_000),
    "long_words": ("word_chars", "n_words", 100),
    "dup_lines": ("n_dup_lines", "n_lines", 10_000),
    "repeat_words": ("n_repeat_words", "n_words", 10_000),
}
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS.encode())] = True


def _sums(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many marks each segment has."""
    out = np.zeros(len(offsets) - 1, np.int64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(marks, offsets[:-1][full], dtype=np.int64)
    return out


def repeated_words(words: np.ndarray, whose: np.ndarray, run: int = RUN) -> np.ndarray:
    """How many words of each text lie in runs of ``run`` words that start twice or more in it."""
    sizes = np.diff(whose)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.flatnonzero(np.arange(len(words)) + run <= whose[1:][owner]) if len(words) else np.zeros(0, np.int64)
    inside = np.zeros(len(words) + 1, np.int32)
    if len(starts):
        keys = mix(grams(words, run)[starts] ^ mix(owner[starts].astype(U) + U(1)))
        order = np.sort(keys)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            again = starts[np.isin(keys, twice)]
            np.add.at(inside, again, 1)
            np.add.at(inside, again + run, -1)
    return _sums(np.cumsum(inside)[:-1] > 0, whose)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b for big in batches for b in packed([big], "text", 2 << 20)):
        data, offsets = text_bytes(batch.column("text"))
        words, whose = word_hashes(data, offsets, lower=False)
        lines, again = [], []
        for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
            own = [x for x in data[a:b].tobytes().split(b"\n") if x.strip()]
            lines.append(len(own))
            again.append(len(own) - len(set(own)))
        counts = (
            np.diff(whose),
            _sums(_IS_WORD[data] & ((data & 0xC0) != 0x80), offsets),
            _sums(_IS_SYMBOL[data], offsets),
            lines,
            again,
            repeated_words(words, whose),
        )
        yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, pa.int64()) for c in counts)], names=["row", *MEASURES])


def measure(docs: DataFrame) -> DataFrame:
    """(row, measures): every row of ``docs`` but its text as a struct, beside the measures of its whole text."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row"), docs["text"].cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_measured, f"row {kind}, " + ", ".join(f"{m} long" for m in MEASURES))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rounded(rate: Column) -> Column:
    """Two decimal digits of a whole number, a million at most: a few hundred values."""
    rate = F.least(rate, F.lit(1_000_000))
    return F.when(rate < 100, rate).otherwise(
        rate - F.when(rate < 1000, rate % 10).when(rate < 10_000, rate % 100).when(rate < 100_000, rate % 1000).otherwise(rate % 10_000)
    )


def rate(rule: str) -> Column:
    above, below, scale = RULES[rule]
    return rounded(F.expr(f"{scale} * {above} div greatest({below}, 1)"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), exact up to rounding; 1 from the mean on, where no bound could hold."""
    if k >= n * p:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total = 0.0
    while k >= 0 and term > total * 1e-17:
        total += term
        term *= k * (1 - p) / ((n - k + 1) * p)
        k -= 1
    return min(total, 1.0)


def _walk(limit: float, level: float, cost: int):
    def run(counts: pa.Table) -> pa.Table:
        rows = sorted(zip(*(counts.column(c).to_pylist() for c in ("value", "good", "bad"))), reverse=True)
        n_good, n_bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
        k = caught = 0
        best = None
        for value, good, bad in rows:
            k, caught = k + good, caught + bad
            if binomial_tail(k, n_good, limit) > level:
                break
            gain = caught * n_good - cost * k * n_bad
            if gain > 0 and (best is None or gain > best[0]):
                best = (gain, value, k, caught)
        found = [best] if best else []
        columns = {
            "stratum": counts.column("stratum").slice(0, len(found)),
            "rule": counts.column("rule").slice(0, len(found)),
            "cutoff": pa.array([b[1] for b in found], pa.int64()),
            "n_good": pa.array([n_good for _ in found], pa.int64()),
            "good_lost": pa.array([b[2] for b in found], pa.int64()),
            "bad_caught": pa.array([b[3] for b in found], pa.int64()),
        }
        return pa.table(columns)

    return run


def choose_cutoffs(
    measured: DataFrame, labels: DataFrame, stratum: str = "lang", limit: float = LIMIT, error: float = ERROR, cost: int = COST
) -> DataFrame:
    """(stratum, rule, cutoff, n_good, good_lost, bad_caught) of every certified cutoff; ``row`` of ``measured`` has doc_id and the stratum."""
    marks = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rates = F.array(*[F.struct(F.lit(r).alias("rule"), rate(r).alias("value")) for r in RULES])
    rows = measured.where(~base_failed()).select(
        F.col("row.doc_id").alias("doc_id"), F.col(f"row.{stratum}").cast("string").alias("stratum"), F.inline(rates)
    )
    good, bad = F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")
    counts = rows.join(marks, "doc_id").groupBy("stratum", "rule", "value").agg(good, bad)
    walks = counts.agg(F.count_distinct(F.struct("stratum", "rule"))).first()[0]
    found = _walk(limit / len(RULES), error / max(walks, 1), cost)
    return counts.groupBy("stratum", "rule").applyInArrow(found, "stratum string, rule string, cutoff long, n_good long, good_lost long, bad_caught long")


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``measured`` with base_failed and kept."""
    limits = cutoffs.groupBy(F.col("stratum").alias("_stratum")).agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_{r}") for r in RULES])
    if limits.count() <= BROADCAST:  # else a shuffle join, whose skewed strata adaptive execution splits
        limits = F.broadcast(limits)
    fails = [F.coalesce(rate(r) >= F.col(f"_{r}"), F.lit(False)) for r in RULES]
    joined = measured.join(limits, measured[f"row.{stratum}"].cast("string").eqNullSafe(F.col("_stratum")), "left")
    rejected = base_failed()
    for f in fails:
        rejected = rejected | f
    return joined.select("row", *MEASURES, base_failed().alias("base_failed"), (~rejected).alias("kept"))


def apply_rules(docs: DataFrame, labels: DataFrame, ws: Workspace, stratum: str = "lang") -> DataFrame:
    """(row, measures, base_failed, kept) for every row of ``docs``; measures are written once, texts are not."""
    measured = ws.write(measure(docs), "measured")
    cutoffs = ws.write(choose_cutoffs(measured, labels, stratum), "cutoffs")
    return judge(measured, cutoffs, stratum)


_ROUNDED = "CASE WHEN v < 100 THEN v WHEN v < 1000 THEN v - v % 10 WHEN v < 10000 THEN v - v % 100 WHEN v < 100000 THEN v - v % 1000 ELSE v - v % 10000 END"
_WORD = r"[^\x20\x09-\x0D]+"
_RATES = " UNION ALL ".join(
    f"SELECT r, lang, quality, '{rule}' AS rule, least({scale} * {above} // greatest({below}, 1), 1000000) AS v FROM measured WHERE NOT base_failed"
    for rule, (above, below, scale) in RULES.items()
)
SQL = rf"""
WITH marks AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM documents
), g AS (SELECT r, i, list_slice(ws, i, i + 4) AS g FROM d, LATERAL (SELECT unnest(range(1, len(ws) - 3)) AS i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
cover AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(5) AS x(k) GROUP BY r),
counted AS (
  SELECT d.r, doc_id, lang, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN cover USING (r)
), measured AS (
  SELECT counted.*, quality, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted LEFT JOIN marks USING (doc_id)
), rates AS (SELECT r, lang, quality, rule, {_ROUNDED} AS value FROM ({_RATES})),
counts AS (
  SELECT lang, rule, value, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad FROM rates WHERE quality IS NOT NULL GROUP BY ALL
), walked AS (
  SELECT lang, rule, value, sum(good) OVER p AS n, sum(bad) OVER p AS n_bad, sum(good) OVER w AS k, sum(bad) OVER w AS caught,
    (SELECT count(*) FROM (SELECT DISTINCT lang, rule FROM counts)) AS walks
  FROM counts WINDOW p AS (PARTITION BY lang, rule), w AS (PARTITION BY lang, rule ORDER BY value DESC)
), tails AS (
  SELECT *, CASE WHEN k >= n * {LIMIT / len(RULES)} THEN 1 ELSE list_sum(list_transform(range(CAST(k AS BIGINT) + 1), lambda i:
    exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({LIMIT / len(RULES)}) + (n - i) * ln(1 - {LIMIT / len(RULES)})))) END AS tail FROM walked
), sure AS (
  SELECT *, max(tail) OVER (PARTITION BY lang, rule ORDER BY value DESC) <= {ERROR} / walks AS certified, caught * n - {COST} * k * n_bad AS gain FROM tails
), cutoffs AS (
  SELECT lang, rule, value AS cutoff FROM sure WHERE certified AND gain > 0
  QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY gain DESC, value DESC) = 1
), failed AS (SELECT DISTINCT r FROM rates JOIN cutoffs ON rates.rule = cutoffs.rule AND rates.lang IS NOT DISTINCT FROM cutoffs.lang AND value >= cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM failed) AS kept
FROM measured
"""


@query("op11_quality_rules", SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    ws = Workspace(spark, "op11")
    judged = apply_rules(docs, table(spark, folder, "labels"), ws)
    names = [m for m in MEASURES if m != "n_lines"]
    return ws.result(judged.select("row.doc_id", *names, "base_failed", "kept"))
