"""What the operators share: scratch tables with an owner, Arrow batches, column rules."""

from __future__ import annotations

import atexit
import contextlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.session import scratch_path

#: Between words: space, tab, line feed, vertical tab, form feed, carriage return. ``bytes.split()`` cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL where SQL can say it."""

    def keep(run):
        REGISTRY[name] = Query(run, sql)
        return run

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: how rows are held out. Null ids fall in no bucket (-1)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(-1))


def lower_az(text: Column) -> Column:
    """Lower case for A-Z alone; ``lower`` would also change other letters."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_key(text: Column) -> list[Column]:
    """Two 64-bit columns that tell texts apart; equal texts share them."""
    return [F.xxhash64(F.lit(3), text).alias("ka"), F.xxhash64(F.lit(4), F.length(text), text).alias("kb")]


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two 64-bit columns that tell (id, text) pairs apart, nulls included; equal rows share them."""
    return [
        F.xxhash64(F.lit(1), doc_id, F.isnull(text), text).alias("ka"),
        F.xxhash64(F.lit(2), text, F.length(text), doc_id).alias("kb"),
    ]


class Workspace:
    """The tables one run of an operator writes, under one folder of ``spark.checkpoint.dir``.

    Intermediate tables go as soon as the result is written; the result (narrow: ids and digests) goes when the driver
    process ends, or with ``close``. Tables in that folder survive lost executors.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.n = spark, scratch_path(spark, label), 0
        self.kept: list[str] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        self.kept.append(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back.scratch = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        for df in tables:
            self._delete(df.scratch)
            self.kept.remove(df.scratch)

    def result(self, df: DataFrame, name: str = "result") -> DataFrame:
        """Write the result and remove everything else."""
        before = list(self.kept)
        back = self.write(df, name)
        for path in before:
            self._delete(path)
            self.kept.remove(path)
        atexit.register(self.close)
        return back

    def close(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended first
            self._delete(self.root)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def packed(batches: Iterator[pa.RecordBatch], column: str, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts come to about ``size`` bytes, at least one row each."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(lengths.tolist()):
            if total and total + n > size:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if batch.num_rows > start:
            yield batch.slice(start)
