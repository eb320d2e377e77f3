"""Small JSON files, one for each version, that say which folders make up a table or a set of tables."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Manifest:
    """Versions under ``root``; a version is there as a whole or not at all, and is never written twice."""

    def __init__(self, spark: SparkSession, root: str, folder: str):
        self.spark, self.root, self.folder = spark, root.rstrip("/"), folder
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, version: int) -> str:
        return f"{self.root}/{self.folder}/{version}.json"

    def names(self, folder: str) -> list[str]:
        """What lies in a folder under the root; nothing while it is not there."""
        at = self._path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.names(self.folder) if n.endswith(".json") and not n.startswith("."))

    def get(self, version: int) -> dict:
        return json.loads(self.spark.read.text(self._file(version), wholetext=True).first()[0])

    def put(self, version: int, content: dict) -> None:
        part = self._path(f"{self.root}/{self.folder}/.{version}.part")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if self._fs.exists(self._path(self._file(version))) or not self._fs.rename(part, self._path(self._file(version))):
            raise OSError(f"version {version} is there already under {self.root}/{self.folder}")

    def forget(self, version: int) -> None:
        self._fs.delete(self._path(self._file(version)), False)

    def drop(self, folder: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{folder}"), True)
