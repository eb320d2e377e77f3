"""Benchmark items inside documents: SimHash of item-sized windows, multi-index Hamming blocks, exact check. SQL functions only.

Text is lower-cased (A-Z) and cut into words at ASCII white space; a text's shingles are its runs of five words (of a text with
fewer: all its words). A window of an item of n words is n consecutive words of a document, fewer where the document ends. Window
and item match when the weighted Jaccard similarity of their shingles (weight: how often it occurs) is 0.75 or more.

1. A window can only match an item of its size when at least 75 / 175 of both their shingles together are shared, in any order: all
   windows that hold so many positions whose shingle occurs in an item of that size are proposed, wherever in the item it stands.
   Other windows cannot reach the similarity.
2. The 64-bit SimHash of a window weighs its shingles alike. Two fingerprints that differ in at most ``RADIUS`` bits agree on
   one of RADIUS + 1 blocks entirely, so an equi-join on (size, block, value) finds every pair within the radius.
3. Pairs within the radius are checked exactly, in whole numbers: 100 * sum of minima >= 75 * sum of maxima.

RADIUS is 21 bits: at similarity 0.75 the distance is about 11 with a deviation of 3.

The shingles of all items are broadcast only after they were counted (``BROADCAST``); beyond that the join is a shuffle that
adaptive execution splits. Windows of one document and one place are merged in each task before they are shuffled, and a passage shared by
a third of all documents stays spread over their ids. Null or empty texts and items match nothing. Documents may repeat
ids: the result has one row for an (id, item).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.base import WORD, Workspace, lower_az, query, row_key, table

SHINGLE = 5
PERCENT = 75
BITS = 64
RADIUS = 21
BROADCAST = 200_000


def words_of(text: Column) -> Column:
    """The words of a text, lower-cased."""
    return F.array_remove(F.split(lower_az(text), r"[\x20\x09-\x0D]+"), "")


def shingles_of(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order; null when there are fewer words."""
    runs = F.sequence(F.lit(0), F.size(words) - size)
    return F.when(F.size(words) >= size, F.transform(runs, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)])))


def dense_starts(spots: Column, width: Column, size: Column, percent: int) -> Column:
    """Starts of all windows of ``width`` shingles, in a text of ``size``, that hold enough of the sorted positions ``spots``.

    Two bags of a and b shingles reach the similarity only when they share percent * (a + b) / (100 + percent). With both of full width
    that is ``whole``; a window cut short by the end of the text must itself have, and share, percent of the width.
    """
    whole = F.ceil(2 * percent * width / (100 + percent)).cast("int")
    short = F.ceil(percent * width / 100).cast("int")

    def starts(need: Column, low: Column, high: Column) -> Column:
        """Windows with ``need`` spots: each spot as the first one inside gives a run of starts, and the runs are disjoint."""

        def run(i: Column) -> Column:
            a = F.greatest(F.get(spots, i + need - 1) - width + 1, F.coalesce(F.get(spots, i - 1), F.lit(-1)) + 1, low)
            b = F.least(F.get(spots, i), high)
            return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))

        runs = F.flatten(F.transform(F.sequence(F.lit(0), F.size(spots) - need), run))
        return F.when(F.size(spots) >= need, runs).otherwise(F.array().cast("array<int>"))

    return F.concat(starts(whole, F.lit(0), size - width), starts(short, F.greatest(size - width + 1, F.lit(0)), size - 1))


def simhash(df: DataFrame, keys: list[str], shingles: str) -> DataFrame:
    """(keys, shingles, print): for each bit the majority of the shingles' hashes."""
    each = df.select(*keys, shingles, F.explode(shingles).alias("h"))
    votes = [F.sum(F.shiftright("h", b).bitwiseAND(F.lit(1)) * 2 - 1).alias(f"v{b}") for b in range(BITS)]
    counted = each.groupBy(*keys).agg(F.first(shingles).alias(shingles), *votes)
    bits = [F.when(F.col(f"v{b}") > 0, F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)) for b in range(BITS)]
    out = bits[0]
    for bit in bits[1:]:
        out = out.bitwiseOR(bit)
    return counted.select(*keys, shingles, out.cast("long").alias("print"))


def blocks(df: DataFrame, radius: int) -> DataFrame:
    """A row for each of radius + 1 blocks of the fingerprint, which together hold all its bits."""
    edges = [BITS * k // (radius + 1) for k in range(radius + 2)]
    values = [
        F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("print", a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value"))
        for k, (a, b) in enumerate(zip(edges, edges[1:]))
    ]
    return df.withColumn("b", F.explode(F.array(*values))).select("*", "b.block", "b.value").drop("b")


def _matches(docs: DataFrame, items: DataFrame, percent: int, radius: int, ws: Workspace) -> DataFrame | None:
    """(doc_id, ka, kb, item_id, start, shared, total, aligned): every window that matches an item; ka and kb tell rows apart. None without items."""
    own = items.select("item_id", words_of(items["text"]).alias("w")).where("size(w) > 0")
    own = own.select("item_id", F.size("w").alias("n"), F.least(F.size("w"), F.lit(SHINGLE)).alias("size"), "w")
    lengths = [r[0] for r in own.select("size").distinct().orderBy("size").collect()]  # five values at most
    found = None
    for size in lengths:
        some = own.where(F.col("size") == size).select("item_id", "n", shingles_of(F.col("w"), size).alias("g"))
        places = ws.write(some.select("n", F.explode_outer("g").alias("h")).distinct(), "places")
        few = places.count() <= BROADCAST
        texts = docs.select("doc_id", "text", *row_key(F.col("doc_id"), docs["text"]))
        rows = texts.select("ka", "kb", words_of(F.col("text")).alias("w")).select("ka", "kb", shingles_of(F.col("w"), size).alias("g"))
        # outer: a filter inferred from the plain form would be pushed below the words and split the text for every word
        seeds = rows.select("ka", "kb", F.size("g").alias("all"), F.posexplode_outer("g").alias("at", "h")).join(F.broadcast(places) if few else places, "h")
        spots = seeds.groupBy("ka", "kb", "n").agg(F.first("all").alias("all"), F.sort_array(F.collect_set("at")).alias("spots"))
        starts = spots.select("ka", "kb", "n", dense_starts(F.col("spots"), F.col("n") - size + 1, F.col("all"), percent).alias("starts"))
        # written first: its size is then known, and where it is small the texts need no shuffle
        starts = starts.where("size(starts) > 0").groupBy("ka", "kb").agg(F.collect_list(F.struct("n", "starts")).alias("s"))
        starts = ws.write(starts, "starts")
        again = texts.join(starts, ["ka", "kb"]).select("doc_id", "ka", "kb", words_of(F.col("text")).alias("w"), "s")
        again = again.select("doc_id", "ka", "kb", shingles_of(F.col("w"), size).alias("g"), "s")
        again = again.select("doc_id", "ka", "kb", "g", F.explode("s").alias("s")).select("doc_id", "ka", "kb", "g", "s.n", F.explode("s.starts").alias("start"))
        window = F.slice("g", F.col("start") + 1, F.col("n") - size + 1)
        windows = (
            again.select("doc_id", "ka", "kb", "n", "start", window.alias("wg"))
            .groupBy("ka", "kb", "n", "start").agg(F.first("doc_id").alias("doc_id"), F.first("wg").alias("wg"))
        )
        windows = ws.write(windows, "windows")
        left = blocks(simhash(windows, ["doc_id", "ka", "kb", "n", "start"], "wg"), radius)
        right = blocks(simhash(some, ["item_id", "n"], "g"), radius).withColumnRenamed("print", "item_print")
        near = left.join(right, ["n", "block", "value"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
        near = near.dropDuplicates(["ka", "kb", "start", "item_id"]).select("doc_id", "ka", "kb", "item_id", "start", "wg", "g")
        times = lambda a, h: F.size(F.filter(a, lambda x: x == h))
        shared = F.aggregate(
            F.array_intersect("wg", "g"), F.lit(0), lambda acc, h: acc + F.least(times(F.col("wg"), h), times(F.col("g"), h))
        )
        near = near.withColumn("shared", shared).withColumn("total", F.size("wg") + F.size("g") - F.col("shared"))
        near = near.where(100 * F.col("shared") >= percent * F.col("total"))
        in_place = F.exists(F.zip_with("wg", "g", lambda a, b: a.eqNullSafe(b)), lambda x: x)
        cut_left = F.size(F.filter("wg", lambda x, i: F.array_contains(F.slice("g", i + 1, F.size("g")), x))) > 0
        near = near.withColumn("aligned", in_place | ((F.col("start") == 0) & cut_left))
        near = near.select("doc_id", "ka", "kb", "item_id", "start", "shared", "total", "aligned")
        found = near if found is None else found.unionByName(near)
    return found


def find_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, start_word, shared, total): each item in each document, at its best window.

    Of equally good windows, those with a shared shingle in its place in the item (``aligned``) come first, then the first. ``docs`` has doc_id and text, ``items`` item_id and text; shared / total is the similarity.
    """
    ws = Workspace(docs.sparkSession, "decontaminate")
    found = _matches(docs, items, percent, radius, ws)
    if found is None:
        empty = docs.select("doc_id").limit(0).crossJoin(items.select("item_id").limit(0))
        return empty.select("*", *(F.lit(0).cast("long").alias(c) for c in ("start_word", "shared", "total")))
    best = F.max_by(F.struct("start", "shared", "total"), F.struct(F.col("shared") / F.col("total"), "aligned", -F.col("start"))).alias("r")
    out = found.groupBy("doc_id", "item_id").agg(best)
    out = out.select("doc_id", "item_id", *(F.col(f"r.{a}").cast("long").alias(b) for a, b in (("start", "start_word"), ("shared", "shared"), ("total", "total"))))
    return ws.result(out)


def drop_contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the rows that hold an item. Rows are told apart by id and text, so others with the same id, or none, stay."""
    ws = Workspace(docs.sparkSession, "decontaminate")
    found = _matches(docs.select("doc_id", "text"), items, percent, RADIUS, ws)
    if found is None:
        return docs
    hits = ws.result(found.select(F.col("ka").alias("_tw_ka"), F.col("kb").alias("_tw_kb")).distinct())
    ka, kb = row_key(docs["doc_id"], docs["text"])
    rows = docs.select(F.struct("*").alias("row"), ka.alias("_tw_ka"), kb.alias("_tw_kb"))
    return rows.join(hits, ["_tw_ka", "_tw_kb"], "left_anti").select("row.*")


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')"

SQL = f"""
WITH items AS (SELECT item_id, w, len(w) AS n, least(len(w), 5) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
ig AS (SELECT item_id, n, k, p AS place, array_to_string(w[p + 1:p + k], ' ') AS h FROM items, unnest(range(0, n - k + 1)) AS u(p)),
dg AS (SELECT doc_id, len(w) AS m, s.k, p AS spot, array_to_string(w[p + 1:p + s.k], ' ') AS h
  FROM docs, (SELECT DISTINCT k FROM items) AS s, unnest(range(0, greatest(len(w) - s.k + 1, 0))) AS u(p)),
windows AS (SELECT DISTINCT doc_id, m, k, n, greatest(spot - place, 0) AS start FROM dg JOIN (SELECT DISTINCT n, k, place, h FROM ig) USING (k, h)),
wc AS (SELECT doc_id, n, k, start, h, count(*) AS c FROM windows JOIN dg USING (doc_id, m, k)
  WHERE spot >= start AND spot + k <= start + n GROUP BY ALL),
wn AS (SELECT doc_id, n, k, start, sum(c) AS size FROM wc GROUP BY ALL),
ic AS (SELECT item_id, n, k, h, count(*) AS c FROM ig GROUP BY ALL),
pairs AS (SELECT doc_id, item_id, start, wn.size + n - k + 1 - sum(least(wc.c, ic.c)) AS total, sum(least(wc.c, ic.c)) AS shared
  FROM wc JOIN ic USING (n, k, h) JOIN wn USING (doc_id, n, k, start) GROUP BY doc_id, item_id, start, n, k, wn.size),
ok AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared / total DESC, start) AS r FROM pairs WHERE 100 * shared >= 75 * total)
SELECT doc_id, item_id, start AS start_word, CAST(shared AS BIGINT) AS shared, CAST(total AS BIGINT) AS total FROM ok WHERE r = 1
"""


@query("op10_decontaminate", SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return find_items(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
