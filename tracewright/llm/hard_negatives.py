"""Hard negatives: for an anchor and each of its positives, the best other-label vectors whose score lies in a window below the positive's.

Components become whole numbers, floor(256 * x); a score is the inner product with the anchor.

Index. Vectors are ordered by label and by their place on a Hilbert curve through the ``AXES`` main directions, and written in that order as
Parquet, cut into blocks of ``BLOCK`` rows of one label. The directions come from at most about ``2 * SAMPLE`` vectors; they only
decide who is whose neighbour. Every vector is indexed, and results do not depend on the order. The zone map has the least and greatest
value of each dimension in each block.

Search. By interval arithmetic the scores of an anchor a in a block lie between sum min(a_d lo_d, a_d hi_d) and sum max(a_d lo_d, a_d hi_d).
An anchor asks for windows of scores; a block is read for it only if its interval meets one of them. Positives are one window, open
above, over blocks of the anchor's label; negatives are a window for each positive over the others. A first look at the most promising
block raises the windows' lower ends to the k-th score found there; what is left is read once. Asks stream past one copy of
each block, so a task holds one block, however many ask for it.

Zone maps of more than ``TOP`` blocks are not broadcast whole: blocks of one partition form a node with its own zone map, 64 nodes the next
one, until the top is small enough; asks go down the levels by equi-joins with the children of the nodes they meet.

Rows with null id or label, or a vector that is null, empty, or holds null or non-finite components, take no part. Shorter vectors count as
padded with zeros. Rows that repeat an id are candidates each, but never for an anchor of that id; each different one of them is an
anchor of its own, equal ones are one. Scores beyond 64 bits are held at the end of their range. Hot labels and a vector that a third of the rows
share only make more blocks: ties on the curve are dealt out by a hash of the row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm.base import Workspace, query, table

AXES = 8
BITS = 7
BLOCK = 2048
SAMPLE = 4096
TOP = 4096
_FAN = 6  # bits: 64 nodes make the next one
_PARTITION = 20  # bits of a block's number within its partition
_EXACT = float(1 << 52)
_LEAST, _MOST = -(2**63), 2**63 - 1
_ASK = "vec_id long, key long, label string, v array<double>, lows array<long>, highs array<long>"
_FOUND = "vec_id long, key long, slot int, other long, score long"


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _lists(rows: np.ndarray) -> pa.ListArray:
    offsets = np.arange(0, rows.size + 1, max(rows.shape[1], 1), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


def whole_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v, key) of the rows that take part; vectors of one length, key a hash of the whole row."""
    fine = F.expr(
        "vec_id IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0"
        " AND forall(embedding, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('Infinity'))"
    )
    v = F.transform("embedding", lambda e: F.floor(e.cast("double") * 256).cast("double")).alias("v")
    good = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v)
    least, most = good.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if least != most:
        good = good.withColumn("v", F.slice(F.concat("v", F.array_repeat(F.lit(0.0), most)), 1, most))
    return good.withColumn("key", F.xxhash64("vec_id", "label", "v"))


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points (rows) with whole coordinates below 2^bits, by untwisting one bit level after the other."""
    x = [c.astype(np.int64) for c in cells.T]
    level = 1 << (bits - 1)
    while level > 1:
        below = level - 1
        for i in range(len(x)):
            high = (x[i] & level) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(high, x[0] ^ below, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        level >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros(len(cells), np.int64)
    for k in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << k), (1 << k) - 1, 0)
    place = np.zeros(len(cells), np.int64)
    for k in range(bits - 1, -1, -1):
        for c in x:
            place = (place << 1) | (((c ^ flip) >> k) & 1)
    return place


def _placed(axes: np.ndarray, low: np.ndarray, high: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                share = (_matrix(batch.column("v")) @ axes - low) / np.where(high > low, high - low, 1)
                place = hilbert(np.clip(np.floor(share * (1 << BITS)), 0, (1 << BITS) - 1), BITS)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "place"])

    return run


def _cut(size: int):
    """Numbers the blocks of a sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() << _PARTITION) - 1
        label, filled = None, 0
        for batch in batches:
            block = np.empty(batch.num_rows, np.int64)
            for i, own in enumerate(batch.column("label").to_pylist()):
                if own != label or filled == size:
                    number, label, filled = number + 1, own, 0
                block[i] = number
                filled += 1
            yield pa.RecordBatch.from_arrays([pa.array(block), *(batch.column(c) for c in ("label", "vec_id", "v"))], names=["block", "label", "vec_id", "v"])

    return run


def _extents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label, lo, hi) of what a batch has of each block."""
    for batch in batches:
        if batch.num_rows:
            node, v = batch.column("block").to_numpy(), _matrix(batch.column("v"))
            begin = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[begin]), batch.column("label").take(pa.array(begin)), _lists(np.minimum.reduceat(v, begin)), _lists(np.maximum.reduceat(v, begin))],
                names=["node", "label", "lo", "hi"],
            )


def _together(extents: DataFrame) -> DataFrame:
    """One zone for each (node, label)."""
    ends = extents.select("node", "label", F.posexplode(F.arrays_zip("lo", "hi")).alias("d", "e"))
    ends = ends.groupBy("node", "label", "d").agg(F.min("e.lo").alias("lo"), F.max("e.hi").alias("hi"))
    line = F.sort_array(F.collect_list(F.struct("d", "lo", "hi")))
    return ends.groupBy("node", "label").agg(line.alias("e")).select("node", "label", F.col("e.lo").alias("lo"), F.col("e.hi").alias("hi"))


class Index:
    """Blocks in curve order, and their zone maps from the blocks up."""

    def __init__(self, rows: DataFrame, ws: Workspace, block: int, top: int):
        n = rows.count()
        part = int(min(1.0, SAMPLE / max(n, 1)) * (1 << 20))
        sample = rows.where(F.pmod("key", F.lit(1 << 20)) <= part).select("v").limit(2 * SAMPLE).toArrow()
        points = _matrix((sample if sample.num_rows else rows.select("v").limit(1).toArrow()).column("v"))
        axes = np.linalg.svd(points - points.mean(axis=0), full_matrices=False)[2][:AXES].T
        seen = points @ axes
        place = rows.mapInArrow(_placed(axes, seen.min(axis=0), seen.max(axis=0)), "vec_id long, label string, v array<double>, key long, place long")
        order = ["label", "place", "key", "vec_id"]
        tasks = max(1, n // (8 * block))
        blocks = place.repartitionByRange(tasks, *order[:3]).sortWithinPartitions(*order).mapInArrow(_cut(block), "block long, label string, vec_id long, v array<double>")
        self.blocks = ws.write(blocks, "blocks")
        zone = "node long, label string, lo array<double>, hi array<double>"
        self.zones = [ws.write(_together(self.blocks.mapInArrow(_extents, zone)), "zones")]
        self.shifts: list[int] = []
        while self.zones[-1].count() > top and len(self.shifts) < 12:
            self.shifts.append(_FAN if self.shifts else _PARTITION)
            above = self.zones[-1].withColumn("node", F.shiftright("node", self.shifts[-1]))
            self.zones.append(ws.write(_together(above), "zones"))


def _bounds(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest scores of vectors (rows) in zones (columns), rounded outwards."""
    above, below = np.maximum(v, 0), np.minimum(v, 0)
    slack = 0.5 + 1e-12 * (np.abs(v) @ np.maximum(np.abs(lo), np.abs(hi)).T)
    return above @ lo.T + below @ hi.T - slack, above @ hi.T + below @ lo.T + slack


def _meets(batch: pa.RecordBatch, row: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether the interval [least, most] found for each of the rows meets one of that row's windows."""
    lows, highs = (batch.column(c) for c in ("lows", "highs"))
    offsets = lows.offsets.to_numpy()
    low, high = lows.values.to_numpy(zero_copy_only=False).astype(float), highs.values.to_numpy(zero_copy_only=False).astype(float)
    out = np.zeros(len(row), bool)
    count = np.diff(offsets)[row]
    for k in range(int(count.max(initial=0))):
        has = np.flatnonzero(count > k)
        at = offsets[row[has]] + k
        out[has] |= (most[has] >= low[at]) & (least[has] <= high[at])
    return out


def _asked(batch: pa.RecordBatch, row: np.ndarray, node: np.ndarray, most: np.ndarray) -> pa.RecordBatch:
    names = [part.split()[0] for part in _ASK.split(", ")]
    take = pa.array(row)
    return pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in names), pa.array(node), pa.array(most)], names=[*names, "node", "most"])


def _at_top(data, same: bool, first: bool):
    """Asks with each top node of the right labels whose scores may lie in their windows; with ``first``, the most promising one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, label, lo, hi = data.value
        for big in batches:
            for start in range(0, big.num_rows, 512):
                batch = pa.RecordBatch.from_struct_array(pa.concat_arrays([big.slice(start, 512).to_struct_array()]))
                least, most = _bounds(_matrix(batch.column("v")), lo, hi)
                right = (np.array(batch.column("label").to_pylist(), dtype=object)[:, None] == label[None, :]) == same
                if first:
                    best = np.where(right, most, -np.inf).argmax(axis=1)
                    row = np.flatnonzero(right[np.arange(len(best)), best])
                    column = best[row]
                else:
                    row, column = np.nonzero(right)
                met = _meets(batch, row, least[row, column], most[row, column])
                row, column = row[met], column[met]
                yield _asked(batch, row, node[column], most[row, column])

    return run


def _below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Asks beside the zone of one child node each: those it may answer."""
    for batch in batches:
        if batch.num_rows:
            v, lo, hi = (_matrix(batch.column(c)) for c in ("v", "lo", "hi"))
            ends = np.stack([v * lo, v * hi])
            slack = 0.5 + 1e-12 * np.abs(ends).max(axis=0).sum(axis=1)
            least, most = ends.min(axis=0).sum(axis=1) - slack, ends.max(axis=0).sum(axis=1) + slack
            row = np.arange(batch.num_rows)
            row = row[_meets(batch, row, least, most)]
            yield _asked(batch, row, batch.column("node").to_numpy()[row], most[row])


def route(asks: DataFrame, index: Index, same: bool, first: bool = False) -> DataFrame:
    """Asks with the block (``node``) of every block they must read, or with the most promising one of those."""
    top = index.zones[-1].toArrow()
    data = asks.sparkSession.sparkContext.broadcast(
        (top.column("node").to_numpy(), np.array(top.column("label").to_pylist(), dtype=object), _matrix(top.column("lo")), _matrix(top.column("hi")))
    )
    kind = _ASK + ", node long, most double"
    met = asks.mapInArrow(_at_top(data, same, first), kind)
    for zones, shift in zip(reversed(index.zones[:-1]), reversed(index.shifts)):
        child = zones.select(F.shiftright("node", shift).alias("parent"), F.col("label").alias("zone"), F.col("node").alias("child"), "lo", "hi")
        right = F.col("zone") == F.col("label") if same else F.col("zone") != F.col("label")
        pairs = met.withColumnRenamed("node", "parent").drop("most").join(child, "parent").where(right)
        met = pairs.select(*(part.split()[0] for part in _ASK.split(", ")), F.col("child").alias("node"), "lo", "hi").mapInArrow(_below, kind)
        met = met.dropDuplicates(["vec_id", "key", "node"])  # a node may stand under several labels
        if first:
            best = F.max_by(F.struct(*met.columns), F.struct("most", "node")).alias("m")
            met = met.groupBy("vec_id", "key").agg(best).select("m.*")
    return met.drop("most")


def _scan(k: int):
    """Streams asks past the block they follow; gives the k best scores in each of their windows."""

    def best(ids: np.ndarray, x: np.ndarray, asks: pa.RecordBatch) -> Iterator[tuple]:
        q = _matrix(asks.column("v"))
        if np.abs(x).max() * np.abs(q).max() * x.shape[1] >= _EXACT:  # too large for doubles: whole numbers of any size
            x, q = (np.array([[int(c) for c in r] for r in m], dtype=object) for m in (x, q))
        lows, highs = (asks.column(c).to_pylist() for c in ("lows", "highs"))
        keys = asks.column("key").to_pylist()
        for start in range(0, len(q), 256):
            scores = q[start : start + 256] @ x.T
            for i, own in enumerate(asks.column("vec_id").slice(start, 256).to_pylist()):
                score = scores[i]
                for slot, (low, high) in enumerate(zip(lows[start + i], highs[start + i])):
                    low, high = (-np.inf if low == _LEAST else low), (np.inf if high == _MOST else high)
                    fit = np.flatnonzero((score >= low) & (score <= high) & (ids != own))
                    if score.dtype != object and len(fit) > 4 * k:  # ties at the k-th score stay
                        fit = fit[score[fit] >= np.partition(score[fit], len(fit) - k)[len(fit) - k]]
                    for j in sorted(fit.tolist(), key=lambda j: (-score[j], ids[j]))[:k]:
                        yield own, keys[start + i], slot, int(ids[j]), max(_LEAST, min(_MOST, int(score[j])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        ids = x = None
        for batch in batches:
            block, kind = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cut = np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1
            out: list[tuple] = []
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(block)]):
                part = pa.RecordBatch.from_struct_array(pa.concat_arrays([batch.slice(a, b - a).to_struct_array()]))
                if a == b:
                    continue
                if block[a] != now:
                    now, held, ids, x = block[a], [], None, None
                if kind[a] == 0:
                    held.append((part.column("vec_id").to_numpy(), _matrix(part.column("v"))))
                    continue
                if ids is None and held:
                    ids, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                if ids is not None:
                    out += best(ids, x, part)
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[p.split()[0] for p in _FOUND.split(", ")])

    return run


def scan(routed: DataFrame, index: Index, k: int) -> DataFrame:
    """(vec_id, key, slot, other, score): the k best of each block in each window (slot) of an ask."""
    wanted = routed.select(F.col("node").alias("block")).distinct()
    asks = routed.select(F.col("node").alias("block"), F.lit(1).alias("kind"), "vec_id", "v", "key", "lows", "highs")
    here = index.blocks.join(wanted, "block", "left_semi").select("block", F.lit(0).alias("kind"), "vec_id", "v")
    rows = here.unionByName(asks, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind")
    return rows.mapInArrow(_scan(k), _FOUND)


def _raised(asks: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The asks with the lower ends of their windows at the k-th score found so far."""
    lists = found.groupBy("vec_id", "key", "slot").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    least = lists.where(F.size("s") >= k).select("vec_id", "key", F.struct("slot", F.get("s", F.lit(k - 1)).alias("least")).alias("at"))
    least = least.groupBy("vec_id", "key").agg(F.map_from_entries(F.collect_list("at")).alias("least"))
    higher = F.when(F.col("least").isNull(), F.col("lows")).otherwise(
        F.transform("lows", lambda low, slot: F.greatest(low, F.coalesce(F.try_element_at("least", slot), low)))
    )
    return asks.join(least, ["vec_id", "key"], "left").withColumn("lows", higher).select(*(p.split()[0] for p in _ASK.split(", ")))


def search(asks: DataFrame, index: Index, ws: Workspace, k: int, same: bool) -> DataFrame:
    """(vec_id, key, slot, rank, other, score): the k best in each window of each ask, in blocks of its label or of all others."""
    first = ws.write(scan(route(asks, index, same, first=True), index, k), "first")
    found = scan(route(_raised(asks, first, k), index, same), index, k)
    order = Window.partitionBy("vec_id", "key", "slot").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, ws: Workspace, every: int = 100, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), block: int = BLOCK, top: int = TOP
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``vectors`` (vec_id, label, embedding).

    Anchors are the rows whose vec_id is divisible by ``every``. ``window`` holds the bounds of a negative's score in percent of the positive's.
    """
    spark = vectors.sparkSession
    rows = ws.write(whole_rows(vectors.select("vec_id", "label", "embedding")), "whole")
    if rows.isEmpty():
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    index = Index(rows, ws, block, top)
    anchors = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "key"])
    whole = F.array(F.lit(_LEAST)), F.array(F.lit(_MOST))
    asks = ws.write(anchors.select("vec_id", "key", "label", "v", whole[0].alias("lows"), whole[1].alias("highs")), "asks")
    near = ws.write(search(asks, index, ws, positives, same=True).select("vec_id", "key", F.col("other").alias("positive_id"), "score"), "positives")
    hundredths = [F.expr(f"transform(scores, p -> cast({end}(cast(p as decimal(20, 0)) * {share} / 100) as bigint))") for end, share in zip(("ceil", "floor"), window)]
    windows = near.groupBy("vec_id", "key").agg(F.sort_array(F.collect_set("score")).alias("scores"))
    windows = windows.withColumns({"lows": hundredths[0], "highs": hundredths[1]})
    asks = ws.write(asks.drop("lows", "highs").join(windows, ["vec_id", "key"]), "windows")
    hard = search(asks, index, ws, negatives, same=False)
    scores = asks.select("vec_id", "key", F.posexplode("scores").alias("slot", "score"))
    pairs = near.join(scores, ["vec_id", "key", "score"])
    return pairs.join(hard.withColumnRenamed("score", "negative_score"), ["vec_id", "key", "slot"]).select(
        F.col("vec_id").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"), F.col("score").alias("positive_score"), "negative_score"
    )


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, CAST(list_inner_product(a.v, x.v) AS BIGINT) AS score
  FROM v a JOIN v x ON a.vec_id <> x.vec_id WHERE a.vec_id % 100 = 0
), p AS (SELECT anchor_id, vec_id AS positive_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) <= 10
"""


@query("op13_hard_negatives", SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    vectors = table(spark, folder, "embeddings").select("vec_id", moved, "embedding")
    ws = Workspace(spark, "op13")
    return ws.result(mine(vectors, ws))
