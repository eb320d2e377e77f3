"""Tables that a stream writes batch by batch, with one commit marker for all of them.

A batch writes a folder of each table it adds to; nobody sees them until the batch's marker lists them. A batch whose marker stands is done and is
not run again. When ``fan`` folders of one size class have gathered, the commit merges them into one of the next class, so n batches
leave about ``fan`` * log(n) folders and a row is rewritten log(n) times at most. Merged folders go one commit later, for readers that
still follow the marker before. A table with a ``reduce`` function (latest row of each key, say) is reduced when folders merge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tracewright.sources.manifest import Manifest

Reduce = Callable[[DataFrame], DataFrame]
FAN = 8


class BatchTables:
    """One run of one batch, or (without ``batch``) a reader of what was committed last."""

    def __init__(self, spark: SparkSession, root: str, batch: int | None = None, reduce: dict[str, Reduce] | None = None, fan: int = FAN):
        self.spark, self.root, self.batch, self.reduce, self.fan = spark, root.rstrip("/"), batch, reduce or {}, fan
        self._marks = Manifest(spark, self.root, "_commits")
        marks = self._marks.versions()
        self.done = batch is not None and batch in marks
        before = [m for m in marks if batch is None or m < batch]
        self._old = before[:-1]
        self._last = self._marks.get(before[-1]) if before else {"tables": {}, "merged": []}
        self._new: dict[str, str] = {}
        self._schemas: dict[str, T.StructType] = {}

    def read(self, name: str, schema: T.StructType) -> DataFrame:
        """The rows of all committed batches, not those of the batch at work."""
        folders = [f"{self.root}/{name}/{f}" for f in self._last["tables"].get(name, [])]
        rows = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        return self.reduce[name](rows) if name in self.reduce else rows

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write what this batch adds to a table; a folder left by a failed try is overwritten."""
        folder = f"0-{self.batch}-{self.batch}"
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/{folder}")
        self._new[name], self._schemas[name] = folder, df.schema
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}/{folder}")

    def _merged(self, name: str, folders: list[str], gone: list[str]) -> list[str]:
        """Folders with full size classes merged, smallest first."""
        while len(same := [f for f in folders if f.split("-")[0] == folders[-1].split("-")[0]]) >= self.fan:
            size, first = same[0].split("-")[:2]
            merged = f"{int(size) + 1}-{first}-{self.batch}"
            rows = self.spark.read.schema(self._schemas[name]).parquet(*[f"{self.root}/{name}/{f}" for f in same])
            rows = self.reduce[name](rows) if name in self.reduce else rows
            files = max(1, len(same) // 2)
            rows.coalesce(files).write.mode("overwrite").parquet(f"{self.root}/{name}/{merged}")
            gone += [f"{name}/{f}" for f in same]
            folders = [f for f in folders if f not in same] + [merged]
        return folders

    def commit(self, keep: tuple[str, ...] = ()) -> None:
        """Let readers see this batch. Tables not in ``keep`` (all, if it is empty) hold this batch alone, for one commit."""
        gone: list[str] = []
        tables = {n: list(f) for n, f in self._last["tables"].items()}
        for name, folder in self._new.items():
            if keep and name not in keep:
                gone += [f"{name}/{f}" for f in tables.pop(name, [])]
                tables[name] = [folder]
            else:
                tables[name] = self._merged(name, [*tables.get(name, []), folder], gone)
        self._marks.put(self.batch, {"tables": tables, "merged": gone})
        for folder in self._last["merged"]:  # no reader follows the marker before the last one any more
            self._marks.drop(folder)
        for mark in self._old:
            self._marks.forget(mark)
