"""Exact top-k inner products through a pivot-distance index.

Vectors are turned into whole numbers, floor(256 * x). The index keys each vector by its nearest pivot and its distance to it; the
distances of a pivot are cut into rings of about equal count (annuli). A query with distance D to pivot p and a ring [lo, hi] of p:
by the triangle inequality every vector x of the ring is at least gap = max(lo - D, D - hi, 0) away, so
q.x <= (|q|^2 + max |x|^2 - gap^2) / 2; and q.x <= q.p + |q| * hi. A query first looks at one block of its own ring, which gives a
k-th best score to beat; then it takes the rings by falling bound and stops at the first whose bound is below that score.

Pivots are chosen from at most about ``SAMPLE`` vectors (farthest first); every vector is indexed, and results are exact for any
choice. PIVOTS x RINGS ring summaries are broadcast: their number is fixed. Rings are split into blocks of about ``BLOCK`` vectors by hash of
the id, queries into chunks of about ``CHUNK``; a task works on one block and one chunk, so a vector that a third of the rows share
fills many blocks of one ring and no task.

Vectors that are null, empty, or hold null or non-finite components take no part. Shorter vectors count as padded with zeros. A
score beyond 64 bits is held at the end of their range. A
repeated vec_id is one more candidate for others; a query's own id never is one, and of several rows that query under one id the best hits of
any count. Null ids take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm.base import Workspace, query, table

PIVOTS = 16
RINGS = 8
SAMPLE = 4096
BLOCK = 1024
CHUNK = 1024
_KEYED = "vec_id long, v array<double>, pivot int, dist double, norm double"
_EXACT = float(1 << 52)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 0))


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): whole-number components of the vectors that take part, all of one length."""
    x = F.transform("embedding", lambda e: F.floor(e.cast("double") * 256).cast("double"))
    fine = F.expr("vec_id IS NOT NULL AND size(embedding) > 0 AND forall(embedding, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('Infinity'))")
    good = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"))
    sizes = good.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if sizes[0] == sizes[1]:
        return good
    return good.withColumn("v", F.slice(F.concat("v", F.array_repeat(F.lit(0.0), sizes[1])), 1, sizes[1]))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first from the vector nearest to the mean."""
    if not len(sample):
        return sample
    picked = [int(((sample - sample.mean(axis=0)) ** 2).sum(axis=1).argmin())]
    far = ((sample - sample[picked[0]]) ** 2).sum(axis=1)
    while len(picked) < count and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[picked[-1]]) ** 2).sum(axis=1))
    return sample[picked]


def _assign(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column("v"))
            d = np.stack([np.sqrt(((v - p) ** 2).sum(axis=1)) for p in pivots], axis=1)
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(v)), near]), pa.array(np.sqrt((v**2).sum(axis=1)))],
                names=["vec_id", "v", "pivot", "dist", "norm"],
            )

    return run


@dataclass
class Rings:
    """One line for each ring that has vectors."""

    pivots: np.ndarray
    ring: np.ndarray
    pivot: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    norm: np.ndarray
    blocks: np.ndarray

    def bounds(self, v: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores of queries (rows) in rings (columns), rounded outwards."""
        length = np.sqrt((v**2).sum(axis=1))[:, None]
        d = np.stack([np.sqrt(((v - p) ** 2).sum(axis=1)) for p in self.pivots], axis=1)[:, self.pivot]
        gap = np.maximum(np.maximum(self.lo - d, d - self.hi), 0)
        by_distance = (length**2 + self.norm**2 - gap**2) / 2
        by_pivot = (v @ self.pivots.T)[:, self.pivot] + length * self.hi
        bound = np.minimum(by_distance, by_pivot)
        return bound + 1 + 1e-9 * (length**2 + self.norm**2)


def _route(data):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings: Rings = data.value
        for big in batches:
            for start in range(0, big.num_rows, 1024):
                batch = big.slice(start, 1024)
                least = batch.column("least").to_numpy(zero_copy_only=False)
                bound = rings.bounds(matrix(batch.column("v")))
                order = np.argsort(-bound, axis=1, kind="stable")  # rings by falling bound, up to the first that is too low
                stop = (np.take_along_axis(bound, order, axis=1) >= least[:, None]).sum(axis=1)
                row = np.repeat(np.arange(len(stop)), stop)
                ring = np.concatenate([order[i, :s] for i, s in enumerate(stop)]) if len(stop) else np.zeros(0, np.int64)
                row, ring = np.repeat(row, rings.blocks[ring]), np.repeat(ring, rings.blocks[ring])
                first = np.concatenate(([True], (row[1:] != row[:-1]) | (ring[1:] != ring[:-1]))) if len(row) else np.zeros(0, bool)
                block = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(take), batch.column("v").take(take), batch.column("chunk").take(take),
                     pa.array(rings.ring[ring].astype(np.int32)), pa.array(block.astype(np.int32))],
                    names=["vec_id", "v", "chunk", "ring", "block"],
                )

    return run


def _best(k: int):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[np.ndarray] = []
        if index.num_rows and queries.num_rows:
            x, q = matrix(index.column("v")), matrix(queries.column("v"))
            ids, own = index.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
            exact = np.abs(x).max() * np.abs(q).max() * x.shape[1] < _EXACT
            if not exact:  # too large for doubles: whole numbers of any size
                x, q = (np.array([[int(c) for c in r] for r in m], dtype=object) for m in (x, q))
            for start in range(0, len(q), 256):
                score = q[start : start + 256] @ x.T
                for i, s in enumerate(score):
                    other = np.flatnonzero(ids != own[start + i])
                    if exact and len(other) > 8 * k:  # ties at the k-th score stay
                        level = np.partition(s[other], len(other) - k)[len(other) - k]
                        other = other[s[other] >= level]
                    top = sorted(other.tolist(), key=lambda j: (-s[j], ids[j]))[:k]
                    out += [(own[start + i], int(ids[j]), max(-(2**63), min(2**63 - 1, int(s[j])))) for j in top]
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns)})

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries vec_id % every = 0 of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    ws = Workspace(spark, "pivot-search")
    whole = ws.write(whole_vectors(vectors.select("vec_id", "embedding")), "whole")
    n = whole.count()
    part = int(min(1.0, SAMPLE / max(n, 1)) * (1 << 20))
    sample = whole.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) <= part).select("v").limit(2 * SAMPLE).toArrow()
    pivots = choose_pivots(matrix(sample.column("v")), PIVOTS)
    if not len(pivots):
        pivots = matrix(whole.limit(1).toArrow().column("v"))
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    keyed = ws.write(whole.mapInArrow(_assign(pivots), _KEYED), "keyed")
    cuts = {r[0]: r[1] for r in keyed.groupBy("pivot").agg(F.percentile_approx("dist", [i / RINGS for i in range(1, RINGS)])).collect()}
    edges = F.create_map(*[x for p, c in sorted(cuts.items()) for x in (F.lit(p), F.array(*map(F.lit, c)))])
    ring = F.col("pivot") * RINGS + F.size(F.filter(F.element_at(edges, F.col("pivot")), lambda e: e < F.col("dist")))
    placed = keyed.withColumn("ring", ring.cast("int"))
    stats = placed.groupBy("ring", "pivot").agg(F.min("dist"), F.max("dist"), F.max("norm"), F.count("*")).toArrow()
    column = [c.to_numpy() for c in stats.columns]
    rings = Rings(pivots, *column[:5], -(-column[5] // BLOCK))
    blocks = F.create_map(*[F.lit(int(x)) for pair in zip(rings.ring, rings.blocks) for x in pair])
    index = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.element_at(blocks, F.col("ring"))).cast("int"))
    index = ws.write(index.select("vec_id", "v", "ring", "block"), "index")
    asked = index.where(F.pmod("vec_id", F.lit(every)) == 0)
    chunks = max(1, -(-asked.count() // CHUNK))
    asked = ws.write(asked.withColumn("chunk", F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(chunks)).cast("int")), "asked")

    def scored(queries: DataFrame) -> DataFrame:
        keys = ["ring", "block", "chunk"]
        wanted = queries.select(*keys).distinct()
        left = index.join(wanted, ["ring", "block"]).select(*(F.col(c).alias(c) for c in (*keys, "vec_id", "v")))
        return left.groupBy(*keys).cogroup(queries.select(*keys, "vec_id", "v").groupBy(*keys)).applyInArrow(_best(k), "query_id long, vec_id long, score long")

    first = scored(asked).groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    first = first.select(F.col("query_id").alias("vec_id"), F.get("s", F.lit(k - 1)).cast("double").alias("least"))
    start = asked.join(first, "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))).select("vec_id", "v", "chunk", "least")
    routed = ws.write(start.mapInArrow(_route(spark.sparkContext.broadcast(rings)), "vec_id long, v array<double>, chunk int, ring int, block int"), "routed")
    found = scored(routed)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ws.result(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(x.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op6_pivot_search", SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"))
