"""Near-duplicate documents by minwise hashing with tensored banding, every link confirmed on full shingle sets.

A document's set holds its distinct 5-word shingles (A-Z lower-cased); with one to four words, the whole sequence is its one
shingle. Two documents are linked when 100 * |A n B| >= 75 * |A u B|. Empty documents are linked with nothing.

Banding: 256 tables, each keyed by four minhashes, would need 1024 of them. Here two collections of 16 half keys of two
minhashes each are drawn, and table (i, j) is keyed by the pair (left i, right j): 64 minhashes for 256 tables. A pair at
similarity s misses all tables with a chance of at most 2 * (1 - s^2)^16: 4e-6 at 0.75, 5e-12 at 0.9.

1. Equal sets are one class (128 bits of the set); only class representatives go on.
2. Left halves are counted first; a half key nobody shares opens no table. Only the others meet right halves.
3. Each table entry of two or more members links its members to its smallest one (a star, not all pairs). The pairs are
   confirmed on the full sets, and links give components by alternating stars.
4. Members of entries that still hold several components may have links no star tried. They share a link only if they share one of
   the rarest quarter of their shingles, by counts over all these sets (prefix filtering, exact). For each such shingle the members outside its largest
   component are checked against all members of other components whose set sizes, and what follows the shingle in both sets
   (positional filtering, exact), allow 0.75. So no link is lost inside an entry, and a large group of near copies costs one
   star and not its square.

Sets are only built for documents that share an entry. Hot keys: counts are partial in each task; stars and checks are
equi-joins, which adaptive execution splits. Nothing grows with a group in one task; the driver sees counts only.

Null texts and texts without words: n_shingles 0, their own component, kept. Rows that repeat a doc_id are one document
whose text is the one with the smallest (set size, set key). A null doc_id takes no part and stands alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.base import WORD, Workspace, packed, query, table
from tracewright.llm.words import U, grams, mix, text_bytes, word_hashes

SHINGLE = 5
PERCENT = 75
HALVES = 16
WIDTH = 2

_SKETCH = "doc_id long, n long, ka long, kb long, left array<long>, right array<long>"


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and len + 1 offsets."""
    words, whose = word_hashes(*text_bytes(column), lower=True)
    runs = grams(words, size)
    sets = []
    for a, b in zip(whose[:-1].tolist(), whose[1:].tolist()):
        if b - a >= size:
            sets.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            sets.append(grams(words[a:b], b - a, 0x5851F42D4C957F2D + b - a))
        else:
            sets.append(np.zeros(0, U))
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)
    return np.concatenate(sets) if sets else np.zeros(0, U), offsets


def _set_keys(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128 bits of each set, as two rows; zeros for an empty one."""
    full = np.flatnonzero(np.diff(offsets))
    sums = np.zeros((2, len(offsets) - 1), np.int64)
    if len(full):
        starts = offsets[:-1][full]
        sums[0, full] = np.add.reduceat(mix(values), starts).view(np.int64)
        sums[1, full] = np.add.reduceat(mix(values ^ U(0xD6E8FEB86659FD93)), starts).view(np.int64)
    return sums


def _sketches(shingle: int, halves: int, width: int):
    seeds = mix(np.arange(1, 2 * halves * width + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)

    def keys(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One row of 2 * halves half keys for each set that isn't empty."""
        out = np.empty((len(offsets), 2 * halves), U)
        for k in range(2 * halves):
            half = np.full(len(offsets), k + 1, U)
            for s in seeds[k * width : (k + 1) * width]:
                half = mix(half ^ np.minimum.reduceat((values ^ (s >> U(7))) * s, offsets))
            out[:, k] = half
        return out.view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for big in batches for b in packed([big], "text", 4 << 20)):
            values, offsets = shingle_sets(batch.column("text"), shingle)
            n = np.diff(offsets)
            full = np.flatnonzero(n)
            sums = _set_keys(values, offsets)
            half = np.zeros((len(n), 2 * halves), np.int64)
            if len(full):
                half[full] = keys(values, offsets[:-1][full])
            lists = [
                pa.ListArray.from_arrays(
                    pa.array(np.arange(0, len(n) * halves + 1, halves, dtype=np.int32)), pa.array(half[:, a : a + halves].ravel())
                )
                for a in (0, halves)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(sums[0]), pa.array(sums[1]), *lists],
                names=["doc_id", "n", "ka", "kb", "left", "right"],
            )

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for big in batches for b in packed([big], "text", 4 << 20)):
            values, offsets = shingle_sets(batch.column("text"), shingle)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "shingles"])

    return run


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(node, component) for every node in ``edges`` (a, b); a component is named by its smallest node.

    Alternating stars: each node hands its neighbours on to the smallest one around it, until nothing changes. Minima are
    partial in each task; a hub's neighbours are never together in one.
    """

    def round_(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a"))) if large else e
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = both.where("b > a") if large else both
        linked = moved.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            linked = linked.union(least.select("a", F.col("m").alias("b")))
        return linked.where("a != b").distinct()

    def sign(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = ws.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    seen = sign(now)
    while True:  # every edge runs from a larger node to a smaller one
        after = ws.write(round_(round_(now, True), False), "stars")
        ws.drop(now)
        now, before, seen = after, seen, sign(after)
        if seen == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked by their full sets."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    shared = both.select("a", "b", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("s"))
    return shared.where(F.expr(f"100 * s >= {percent} * (n - s)")).select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, halves: int = HALVES, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of all documents, as the module says."""
    return _labelled(docs, percent, shingle, halves, width)[0]


def _labelled(docs: DataFrame, percent: int, shingle: int, halves: int, width: int, choice: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """What ``near_duplicates`` gives; with ``choice`` also (doc_id, n, ka, kb) of the set that counts for each repeated id, if any is."""
    ws = Workspace(docs.sparkSession, "minhash")
    chosen = None
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    all_rows = ws.write(narrow.mapInArrow(_sketches(shingle, halves, width), _SKETCH), "sketches")
    # a repeated id counts once; which of its texts counts is fixed by the order of the set keys
    repeated = all_rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    if repeated.head(1):
        pick = all_rows.join(repeated.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(
            F.min(F.struct("n", "ka", "kb", "left", "right")).alias("r")
        )
        once = all_rows.join(repeated.select("doc_id"), "doc_id", "left_anti").unionByName(pick.select("doc_id", "r.*"))
        sketches = ws.write(once, "once")
        if choice:  # a workspace of its own: it is read after the result is written
            own = Workspace(docs.sparkSession, "minhash-choice")
            chosen = own.result(sketches.join(repeated.select("doc_id"), "doc_id", "left_semi").select("doc_id", "n", "ka", "kb"))
    else:
        sketches = all_rows
    some = sketches.where("doc_id IS NOT NULL AND n > 0")
    classes = ws.write(some.groupBy("ka", "kb", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    heads = some.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")

    halfs = ws.write(heads.select("doc_id", F.posexplode("left").alias("i", "half")), "left")
    shared = halfs.groupBy("i", "half").count().where("count > 1").select("i", "half")
    open_ = halfs.join(shared, ["i", "half"], "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("i", "half")).alias("halfs"))
    entries = (
        heads.join(open_, "doc_id")
        .select("doc_id", "n", "right", F.explode("halfs").alias("h"))
        .select("doc_id", "n", "h", F.posexplode("right").alias("j", "other"))
        .select(F.xxhash64("h.i", "h.half", "j", "other").alias("entry"), "doc_id", "n")
    )
    entries = ws.write(entries, "entries")
    ws.drop(halfs)
    stars = entries.groupBy("entry").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("entry", "a")
    members = ws.write(entries.join(stars, "entry").select("entry", "a", F.col("doc_id").alias("b"), "n"), "members")
    ws.drop(entries)

    sizes = classes.select(F.col("rep").alias("a"), F.col("n").alias("na"))
    starred = members.where("a < b").select("a", "b", "n").distinct().join(sizes, "a")
    pairs = ws.write(starred.where(f"100 * least(na, n) >= {percent} * greatest(na, n)").select("a", "b"), "pairs")
    # written first: its size is then known, and where it is small the texts need no shuffle
    wanted = ws.write(members.select(F.col("b").alias("doc_id")).distinct(), "wanted")
    texts = narrow.join(wanted, "doc_id", "left_semi")
    if sketches is not all_rows:  # the set that counts is the smallest by its keys
        texts = texts.dropDuplicates(["doc_id", "text"])
    sets = ws.write(texts.mapInArrow(_sets(shingle), "doc_id long, shingles array<long>"), "sets")
    if sketches is not all_rows:
        sets = ws.write(_counted(sets, sketches), "sets")
    links = ws.write(_confirmed(pairs, sets, percent), "links")
    known = components(links, ws)
    known = ws.write(known, "components")

    # what entries with more than one component may still hide
    placed = members.select("entry", F.col("b").alias("doc_id")).join(known.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    placed = placed.withColumn("component", F.coalesce("component", "doc_id"))
    mixed = placed.groupBy("entry").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p < q").select("entry")
    open_docs = ws.write(placed.join(mixed, "entry", "left_semi").select("doc_id", "component").distinct(), "open")
    rows = ws.write(_prefixes(sets.join(open_docs, "doc_id"), ws, percent), "prefixes")
    main = rows.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(
        F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("parts")
    )
    main = main.where("parts > 1").select("key", "main")
    shared = ws.write(rows.join(main, "key"), "shared")
    x = shared.where("component != main").select("key", F.col("doc_id").alias("u"), F.col("component").alias("p"), F.col("n").alias("nu"), F.col("at").alias("i"))
    y = shared.select("key", F.col("doc_id").alias("v"), F.col("component").alias("q"), F.col("n").alias("nv"), F.col("at").alias("j"))
    # their first common shingle and what follows it in the order bounds the overlap
    fits = f"p != q AND {100 + percent} * least(nu - i, nv - j) >= {percent} * (nu + nv)"
    across = x.join(y, "key").where(fits).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    across = ws.write(across.join(pairs, ["a", "b"], "left_anti"), "across")
    more = ws.write(_confirmed(across, sets, percent), "more")
    if more.head(1):
        known = components(links.union(more), ws)
    label = known.select(F.col("node").alias("rep"), "component")
    classed = classes.join(label, "rep", "left").select("ka", "kb", "n", F.coalesce("component", "rep").alias("component_id"))
    out = some.select("doc_id", "n", "ka", "kb").join(classed, ["ka", "kb", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = sketches.where("doc_id IS NULL OR n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    return ws.result(out), chosen


def _prefixes(sets: DataFrame, ws: Workspace, percent: int) -> DataFrame:
    """(key, at, doc_id, n, component): the shingles of each set of which one at least is in every similar set of another component.

    In any fixed order of shingles, two sets of similarity t share one among their first n - ceil(t n) + 1. The order here starts with
    what one component has alone, which cannot be shared and makes no row, and goes on by count, rare shingles first.
    """
    rows = sets.select("doc_id", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    counts = rows.groupBy("key").agg(F.min("component").alias("p"), F.max("component").alias("q"), F.count("*").alias("c"))
    common = ws.write(counts.where("p < q").select("key", "c"), "common")
    # a list holds shingles of one document
    listed = rows.join(common, "key").groupBy("doc_id", "component", "n").agg(F.sort_array(F.collect_list(F.struct("c", "key"))).alias("keys"))
    room = F.size("keys") + 1 - F.expr(f"({percent} * n + 99) div 100").cast("int")
    return (
        listed.withColumn("room", room)
        .where("room > 0")
        .select("doc_id", "component", "n", F.size("keys").alias("m"), F.posexplode(F.slice("keys", F.lit(1), F.col("room"))).alias("place", "k"))
        .select(F.col("k.key").alias("key"), (F.col("n") - F.col("m") + F.col("place")).alias("at"), "doc_id", "n", "component")
    )


def _counted(sets: DataFrame, sketches: DataFrame) -> DataFrame:
    """Of several sets with one id, the one whose sketch counts."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                v = np.array(row["shingles"], np.int64).view(U)
                sums = [mix(v).sum(dtype=U), mix(v ^ U(0xD6E8FEB86659FD93)).sum(dtype=U)]
                ka, kb = np.array(sums, U).view(np.int64).tolist()
                yield pa.RecordBatch.from_pylist([{**row, "ka": ka, "kb": kb}], schema=pa.schema(
                    [("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64())), ("ka", pa.int64()), ("kb", pa.int64())]))

    keyed = sets.mapInArrow(keys, "doc_id long, shingles array<long>, ka long, kb long")
    return keyed.join(sketches.select("doc_id", "ka", "kb"), ["doc_id", "ka", "kb"], "left_semi").select("doc_id", "shingles").dropDuplicates(["doc_id"])


def _of_the_set(shingle: int):
    """The rows whose text has the set (n, ka, kb) that counts for their id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for big in batches for b in packed([big], "text", 4 << 20)):
            values, offsets = shingle_sets(batch.column("text"), shingle)
            found = [np.diff(offsets), *_set_keys(values, offsets)]
            same = np.all([f == batch.column(c).to_numpy() for f, c in zip(found, ("n", "ka", "kb"))], axis=0)
            yield batch.select(["_tw_id", "row"]).filter(pa.array(same))

    return run


def keep_one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with the smallest id. Rows without id stay.

    Of rows that repeat an id, one stays: its set is the one that was compared; of several, the one whose row has the smallest hash.
    """
    found, chosen = _labelled(docs, percent, SHINGLE, HALVES, WIDTH, choice=True)
    kept = found.where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_tw_id"))
    rows = docs.select(F.struct("*").alias("row"), docs["doc_id"].cast("long").alias("_tw_id"), docs["text"].cast("string").alias("text"))
    staying = rows.where("_tw_id IS NOT NULL").join(kept, "_tw_id", "left_semi")
    if chosen is not None:
        chosen = chosen.withColumnRenamed("doc_id", "_tw_id")
        several = staying.join(chosen, "_tw_id")
        out = T.StructType([several.schema["_tw_id"], several.schema["row"]])
        several = several.mapInArrow(_of_the_set(SHINGLE), out)
        # the least row of each task goes on, so a hot id isn't together anywhere
        one = several.groupBy("_tw_id").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
        staying = staying.join(chosen, "_tw_id", "left_anti").select("row").union(one.select("row"))
    return staying.select("row.*").union(rows.where("_tw_id IS NULL").select("row.*"))


SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words
), shingles AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE 100 * c >= 75 * (len(p.s) + len(q.s) - c)
), pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN pairs e ON r.other = e.a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""


@query("op4_minhash_dedup", SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
