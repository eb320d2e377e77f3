"""Files: report CSVs, source trees, paged API answers, stored tables."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from functools import partial
from itertools import batched, chain, groupby
from operator import itemgetter
from uuid import uuid4

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.source import tree_path
from tracewright.sources.quoted import read_quoted_csv

# Columns of the exported files.
BLOCKER_COLUMNS = {
    "StagingDeployCash Issue Number": "deploy_number",
    "StagingDeployCash GitHub URL": "deploy_url",
    "StagingDeployCash Created At": "created_at",
}
BLOCKER_FILE = (
    "`StagingDeployCash Issue` string, `StagingDeployCash Issue Number` bigint, "
    "`StagingDeployCash GitHub URL` string, `StagingDeployCash Created At` timestamp"
)
#: What Spark calls a folder of rows without a value.
NO_NAME = "__HIVE_DEFAULT_PARTITION__"
#: Names of files that Spark unpacks.
PACKED = (".bz2", ".deflate", ".gz", ".lz4", ".snappy", ".zst", ".passthrough")
#: Files of a reading task, and bytes it holds at once (or one file).
READ_FILES, READ_BYTES = 1000, 4 << 20


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a given schema, without line ends in values."""
    return spark.read.csv(path, header=True, schema=schema, escape='"', enforceSchema=False)


def read_blockers(spark: SparkSession, path: str) -> DataFrame:
    """One row per blocker; the free-text issue column, which may hold line ends, is left out."""
    rows = read_quoted_csv(spark, path, BLOCKER_FILE).drop("StagingDeployCash Issue")
    return rows.withColumnsRenamed(BLOCKER_COLUMNS)


def read_merged(spark: SparkSession, path: str, date: str = "merged_at") -> DataFrame:
    """Merged changes as ``id, date`` with ``row``, which orders them as the files do.

    The row id alone would not: Spark packs the pieces of files into tasks by size.
    """
    rows = read_csv(spark, path, f"id bigint, {date} timestamp").withColumnRenamed(date, "date")
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("n"),
    )
    return rows.select("id", "date", place.alias("row"))


def local_path(spark: SparkSession, folder: str) -> str | None:
    """The folder as Python opens it; None for a store that only Spark reaches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    address = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return address.getPath() if address.getScheme() == "file" else None


def _write_files(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files of rows in order of their paths, each made in a hidden folder of the task's own and put in place when it is whole.

    A task that runs again or twice leaves the same files. Tasks that make files in one folder would wait for each other.
    """
    own, made, count = f"{root}/.{uuid4().hex}", set(), 0
    part = f".part-{TaskContext.get().partitionId():05d}"
    os.makedirs(own)
    rows = chain.from_iterable(zip(*(c.to_pylist() for c in batch.columns), strict=True) for batch in batches)
    for path, contents in groupby(rows, itemgetter(0)):
        with open(f"{own}/file", "wb") as out:
            for _, content in contents:
                out.write((content or b"") + b"\n")
        folder = os.path.dirname(f"{root}/{path}")
        if folder not in made:
            os.makedirs(folder, exist_ok=True)
            made.add(folder)
        os.replace(f"{own}/file", f"{root}/{path}{part}")
        count += 1
    os.rmdir(own)
    yield pa.RecordBatch.from_pydict({"files": [count]})


def write_source_tree(tree: DataFrame, folder: str) -> None:
    """``path, content`` as one file for each path ``src/folder/name`` below a new folder; rows of one path share a file, a line end after each.

    On a local or mounted store the tasks write ``src/folder=.../name=....part-00003`` themselves: Spark's writer makes a folder, a second file and
    two processes for each file. In other stores it is used, and a file is ``src/folder=.../name=.../part-...``. No such name is taken for hidden.
    """
    root = local_path(tree.sparkSession, folder)
    parts = F.split("path", "/")
    named = tree.select(F.col("content"), F.get(parts, F.lit(1)).alias("folder"), F.get(parts, F.lit(2)).alias("name"))
    if root is None:
        # every task puts its files in place itself; the folder is new, so a failed run leaves nothing that is read
        spread = named.repartition("folder", "name").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        spread.partitionBy("folder", "name").text(f"{folder}/src")
        return
    steps = [F.concat(F.lit(f"{c}="), F.coalesce(c, F.lit(NO_NAME))) for c in ("folder", "name")]
    rows = named.select(F.concat_ws("/", F.lit("src"), *steps).alias("path"), F.col("content").cast("binary"))
    spread = rows.repartition("path").sortWithinPartitions("path")
    spread.mapInArrow(partial(_write_files, root), "files bigint").write.format("noop").mode("overwrite").save()


def written_path(path: Column) -> Column:
    """The path of a file of ``write_source_tree`` as it was given."""
    return F.regexp_replace(F.regexp_replace(path, "(?<=/)(folder|name)=", ""), r"(/part-[^/]*|\.part-\d+)$", "")


def _files_below(folder: str) -> Iterator[str]:
    """Files in any depth, without those that Spark takes for hidden."""
    with os.scandir(folder) as entries:
        for entry in entries:
            hidden = entry.name.startswith(".") or (entry.name.startswith("_") and "=" not in entry.name) or entry.name.endswith("._COPYING_")
            if entry.is_dir():
                if not hidden or entry.name.startswith(("_metadata", "_common_metadata")):
                    yield from _files_below(entry.path)
            elif entry.is_file() and not hidden:
                yield entry.path


def _list_files(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _ in batches:
        for names in batched(_files_below(root), 10_000):
            yield pa.RecordBatch.from_pydict({"file": pa.array(map(os.fsencode, names), pa.binary())})


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files that hold something, a few MB at a time."""
    paths, values, held = [], [], 0
    for name in chain.from_iterable(batch.column(0).to_pylist() for batch in batches):
        with open(name, "rb") as file:
            value = file.read()
        if value:
            paths.append(f"file:{name.decode(errors='replace')}")
            values.append(value)
            held += len(value)
        if held >= READ_BYTES:
            yield pa.RecordBatch.from_pydict({"address": paths, "value": pa.array(values, pa.binary())})
            paths, values, held = [], [], 0
    yield pa.RecordBatch.from_pydict({"address": pa.array(paths, pa.string()), "value": pa.array(values, pa.binary())})


def read_source_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Every file below a folder as ``path, content``; bytes that are not UTF-8 are dropped, empty and hidden files are left out.

    On a local or mounted store one task lists the files and others read them: Spark's reader lists on the driver, which then holds every file,
    and copies the job's settings for each. It reads other stores and packs small files into tasks by size
    (``spark.sql.files.openCostInBytes`` is what a file counts at least); it also reads trees with compressed files, which it unpacks.
    """
    root = local_path(spark, folder)
    count = packed = 0
    for name in _files_below(root) if root and os.path.isdir(root) else ():
        count, packed = count + 1, packed or name.endswith(PACKED)
    if count and not packed:
        tasks = max(-(-count // READ_FILES), min(count, spark.sparkContext.defaultParallelism))
        listed = spark.range(0, 1, 1, 1).mapInArrow(partial(_list_files, root), "file binary").repartition(tasks, "file")
        files = listed.mapInArrow(_read_files, "address string, value binary").withColumn("value", F.col("value").cast("string"))
        address = F.col("address")
    else:
        files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
        address = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    content = F.replace(F.make_valid_utf8("value"), F.lit(chr(0xFFFD)), F.lit(""))
    return files.select(tree_path(address).alias("path"), content.alias("content"))


def write_documents(df: DataFrame, path: str) -> None:
    """Summaries as JSON lines of ``path, lines``."""
    df.select("path", "lines").write.mode("overwrite").json(path)


def page_values(pages: DataFrame, schema: T.StructType, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """The values of all pages of an API answer, one row each, and the pages that hold no list of values.

    A page that was cut off would otherwise pass for an empty one.
    """
    kept = [c for c in pages.columns if c != body]
    parsed = pages.select("*", F.from_json(body, schema)["values"].alias("_values"))
    values = parsed.select(*kept, F.explode("_values").alias("_value")).select(*kept, "_value.*")
    return values, parsed.where("_values IS NULL").drop("_values")


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{table}.parquet")


def list_issues(issues: DataFrame) -> DataFrame:
    """All issues as they are listed; vectors live in their own table and are not read."""
    return issues.select("id", "repo_id", "title", "steps", "raw_body", "labels", "is_processed", "culprit_pull_requests")


def list_links(links: DataFrame) -> DataFrame:
    return links.select("issue_id", "pull_request_id", "score")


def tenant_scan(table: DataFrame, repo_id: str, columns: Sequence[str]) -> DataFrame:
    """Columns of one repository; prunes files when the table is partitioned by ``repo_id``."""
    return table.filter(F.col("repo_id") == repo_id).select(*columns)


def lookup(requests: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows by key for a table of requests; unknown keys give nulls."""
    return requests.select(*keys).join(table, list(keys), "left")


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet folder, or no rows while it has not been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def save_snapshot(df: DataFrame, root: str, version: int) -> str:
    """Write one version of a table; readers of earlier versions are not disturbed."""
    path = f"{root.rstrip('/')}/version={version}"
    df.write.mode("overwrite").parquet(path)
    return path
