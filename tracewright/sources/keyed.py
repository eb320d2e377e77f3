"""Keyed tables in hash buckets: a write replaces the buckets its keys fall in and leaves the others as they are."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.operators.state import replace_rows, update_columns
from tracewright.sources.manifest import Manifest

BUCKETS = 64


class KeyedTable:
    """A table with one row for each key, as versions; each version's manifest names the folder of every bucket.

    Readers hold on to the version they began with. ``buckets`` is fixed for a table's life: choose it so that one bucket is a few
    hundred MB. Two writers of one version collide: the second fails and writes nothing that anybody reads.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.root, self.schema, self.keys, self.buckets = spark, root.rstrip("/"), schema, list(keys), buckets
        self.manifest = Manifest(spark, self.root, "_versions")

    def _bucket(self) -> Column:
        kinds = {f.name: f.dataType for f in self.schema.fields}
        return F.pmod(F.xxhash64(*[F.col(k).cast(kinds[k]) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        return max(self.manifest.versions(), default=-1)

    def _folders(self, version: int) -> dict[int, int]:
        return {int(b): v for b, v in self.manifest.get(version)["buckets"].items()} if version >= 0 else {}

    def _rows(self, folders: dict[int, int]) -> DataFrame:
        paths = [f"{self.root}/v={v}/bucket={b}" for b, v in sorted(folders.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self._folders(self.version() if version is None else version))

    def _write(self, changes: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
        """Replace the buckets of the changed keys by what ``change`` makes of their rows; gives the new version."""
        last = self.version()
        before = self._folders(last)
        touched = [r[0] for r in changes.select(self._bucket().alias("bucket")).distinct().collect()]  # at most one row for each bucket
        rows = change(self._rows({b: before[b] for b in touched if b in before})).select(self.schema.names)
        now = last + 1
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/v={now}")
        written = {int(n.removeprefix("bucket=")): now for n in self.manifest.names(f"v={now}") if n.startswith("bucket=")}
        after = {b: v for b, v in before.items() if b not in touched} | written
        self.manifest.put(now, {"buckets": {str(b): v for b, v in sorted(after.items())}})
        return now

    def replace(self, rows: DataFrame, version: Sequence[str] = ()) -> int:
        """Insert rows, or replace those with the same key as a whole; of several with one key the last ``version`` counts."""
        return self._write(rows, lambda current: replace_rows(current, rows, self.keys, version))

    def update(self, changes: DataFrame, columns: Sequence[str], version: Sequence[str] = ()) -> int:
        """Set columns of rows that exist."""
        return self._write(changes, lambda current: update_columns(current, changes, self.keys, columns, version))

    def delete(self, gone: DataFrame) -> int:
        return self._write(gone, lambda current: current.join(gone.select(*self.keys), self.keys, "left_anti"))

    def expire(self, keep: int = 2) -> None:
        """Remove versions but the last ``keep``, and bucket folders that none of these names."""
        versions = self.manifest.versions()
        used = {(b, v) for n in versions[-keep:] for b, v in self._folders(n).items()}
        for old in versions[:-keep]:
            self.manifest.forget(old)
        for folder in [n for n in self.manifest.names(".") if n.startswith("v=")]:
            there = [n for n in self.manifest.names(folder) if n.startswith("bucket=")]
            for name in there:
                if (int(name.removeprefix("bucket=")), int(folder.removeprefix("v="))) not in used:
                    self.manifest.drop(f"{folder}/{name}")
