"""Order-dependent steps that hold up when one key has a large part of all rows.

A window over a whole table, or over one hot key, is a single task. Here the order comes from Spark's range
sort, which balances by the full sort key; only per-partition sizes, one small row each, are ever combined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.session import scratch_path

# the planner trims a ranking before its shuffle only up to this rank
RANK_TRIM = 1000
SALTS = 64


def _sorted_table(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """The rows written in global order, with the number of their file and their place in it.

    The table sits in the shared folder, so every later pass sees the same order, reads only the columns it
    needs and does not depend on executors staying alive.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "sorted")
    # one file for each sort task, whatever the session's limit: the place in the file is the place in the task
    df.sort(*order).write.option("maxRecordsPerFile", 0).parquet(path)
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
    return spark.read.schema(df.schema).parquet(path).select(
        "*", part.alias("_part"), F.col("_metadata.row_index").alias("_at")
    )


def _offsets(sizes: DataFrame, amount: str) -> DataFrame:
    """Running total before each file; one row per sort partition, so it is small by construction."""
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return sizes.select(
        "_part",
        F.coalesce(F.sum(amount).over(earlier), F.lit(0)).alias("_before"),
        F.sum(amount).over(everything).alias("_total"),
    )


def sequence_rows(df: DataFrame, order: Sequence[Column | str], start: Column | int = 0, name: str = "seq") -> DataFrame:
    """Number all rows ``start``, ``start + 1``, … in the given (unique) order, without gaps."""
    rows = _sorted_table(df, order)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    begin = F.lit(start) if isinstance(start, int) else start
    numbered = rows.join(F.broadcast(_offsets(sizes, "_rows")), "_part")
    return numbered.withColumn(name, begin + F.col("_before") + F.col("_at")).drop("_at", "_part", "_before", "_total")


def previous_in_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], columns: Sequence[str]
) -> DataFrame:
    """Add ``prev_<column>`` with the values of the row before in the same group, null for the first.

    Neighbours are looked up within each file of the sorted table, and across file borders from the last row of
    the file before, so a group may span any number of tasks.
    """
    rows = _sorted_table(df, [*keys, *order])
    taken = F.struct(*keys, *columns)
    in_file = W.partitionBy("_part").orderBy("_at")
    ends = rows.groupBy("_part").agg(F.max_by(taken, "_at").alias("_end"))
    # one row per file; empty files do not occur among them
    border = ends.select("_part", F.lag("_end").over(W.orderBy("_part")).alias("_border"))
    near = rows.withColumn("_near", F.lag(taken).over(in_file)).join(F.broadcast(border), "_part")
    before = near.withColumn("_before", F.when(F.col("_at") == 0, F.col("_border")).otherwise(F.col("_near")))
    same = F.lit(True)
    for key in keys:
        same = same & F.col(f"_before.{key}").eqNullSafe(F.col(key))
    return before.select(
        *df.columns, *[F.when(same, F.col(f"_before.{c}")).alias(f"prev_{c}") for c in columns]
    )


def place_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "place") -> DataFrame:
    """Zero-based place of each row within its group, whatever the size of the group."""
    rows = sequence_rows(df, [*keys, *order], name="_seq")
    first = rows.groupBy(*keys).agg(F.min("_seq").alias("_first"))
    return rows.join(first, list(keys)).withColumn(name, F.col("_seq") - F.col("_first")).drop("_seq", "_first")


def ordered_chunks(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], item: Column, size: int = 500
) -> DataFrame:
    """Groups as ordered lists, cut into chunks of at most ``size`` so that no list grows with the data.

    ``chunk`` counts from 0 within a group; reading a group's chunks in that order gives all of its items.
    """
    placed = place_in_group(df, keys, order, "_place")
    return (
        placed.groupBy(*keys, F.floor(F.col("_place") / size).alias("chunk"))
        .agg(F.sort_array(F.collect_list(F.struct(F.col("_place").alias("place"), item.alias("item")))).alias("_list"))
        .withColumn("items", F.transform("_list", lambda x: x["item"]))
        .drop("_list")
    )


def rank_slice(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], first: int, last: int, salt_by: Sequence[str]
) -> DataFrame:
    """Rows ranked ``first`` to ``last`` (from 1) within each key.

    The planner keeps only the best ``last`` rows of a key per map task before shuffling. Beyond the rank it is
    willing to do that for, a salted first round does the same.
    """
    if last > RANK_TRIM:
        salt = F.pmod(F.xxhash64(*salt_by), F.lit(SALTS))
        by_salt = W.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", salt)
            .withColumn("_rank", F.row_number().over(by_salt))
            .filter(F.col("_rank") <= last)
            .drop("_salt", "_rank")
        )
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter((F.col("rank") <= last) & (F.col("rank") >= first))


def keep_first(df: DataFrame, keys: Sequence[Column | str], order: str) -> DataFrame:
    """The earliest row of each group of duplicates; ``order`` is unique. Null keys are equal to each other.

    Only a key hash and the order column are aggregated, before the shuffle, so many copies of one row cost
    little, and wide columns stay out of the aggregation.
    """
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    digest = F.sha2(F.to_json(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(columns)])), 256)
    firsts = df.groupBy(digest.alias("_digest")).agg(F.min(order).alias(order)).select(order)
    return df.join(firsts, order, "left_semi")


def latest_by(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The row of each key with the highest (unique) version."""
    newest = df.groupBy(*keys).agg(F.max(version).alias(version))
    return df.join(newest, [*keys, version], "left_semi")


def exact_quantiles(df: DataFrame, value: str, wanted: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per wanted quantile.

    Equal values are counted first; the distinct ones are sorted across the cluster and only the two ranks next
    to each quantile are kept.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    rows = _sorted_table(counted, ["_v"])
    sizes = rows.groupBy("_part").agg(F.sum("_n").alias("_rows"))
    running = W.partitionBy("_part").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    spans = rows.join(F.broadcast(_offsets(sizes, "_rows")), "_part").withColumn(
        "_end", F.col("_before") + F.sum("_n").over(running)
    )
    begin, end, total = F.col("_end") - F.col("_n"), F.col("_end"), F.col("_total")
    asked = F.array(*[F.lit(float(q)) for q in wanted])
    hits = F.filter(
        asked,
        lambda q: (F.floor(q * (total - 1)) < end) & (F.ceil(q * (total - 1)) >= begin),
    )
    near = spans.select("_v", begin.alias("_from"), end.alias("_to"), "_total", F.explode(hits).alias("quantile"))
    at = F.col("quantile") * (F.col("_total") - 1)
    low = (F.floor(at) >= F.col("_from")) & (F.floor(at) < F.col("_to"))
    high = (F.ceil(at) >= F.col("_from")) & (F.ceil(at) < F.col("_to"))
    picked = near.groupBy("quantile").agg(
        F.max(F.when(low, F.col("_v"))).alias("_low"),
        F.max(F.when(high, F.col("_v"))).alias("_high"),
        F.max(at - F.floor(at)).alias("_share"),
    )
    return picked.select(
        "quantile", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_share")).alias("value")
    )
