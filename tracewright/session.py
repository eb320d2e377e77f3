"""Session settings the engine relies on, and where it may write intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import os
import uuid

from pyspark.sql import SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RUNTIME_CONF = {
    # keyed state of streams stays off the executors' heaps
    "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # small partitions are joined up to this much: rows of keys pack to a few bytes each, and a task unpacks and sorts them all
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    # split a hot key even when a later stage could have reused the join's partitioning
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # whole texts go to Python in batches: a few MB at a time, in the worker and in the executor's own buffers
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    if spark.sparkContext.master.startswith("local"):  # workers of a cluster get the package by --py-files
        paths = [ROOT, *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(dict.fromkeys(paths))
    return spark


def local_session(
    cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g", checkpoint_dir: str | None = None
) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tracewright")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named


_scratch: list[str] = []


def _sweep(spark: SparkSession) -> None:
    """Remove the scratch folders of this driver process; nothing reads them after it."""
    for path in _scratch:
        with contextlib.suppress(Exception):  # the session may have ended first
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder, removed when the driver process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(_sweep, spark)
    _scratch.append(path)
    return path
