"""CSV whose quoted values hold line ends, read by many tasks from one large file.

A line begins a record when an even number of quotes stands before it in its file. Each piece of a file, some thousand lines of one block, counts
its own quotes; what earlier pieces add is a prefix sum over one small row for each piece. Lines are put together to records by the
line they began with, which may lie in an earlier piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE = ["file", "block", "run"]
#: Lines of a piece: what one task must hold in order, however large the blocks of a file are.
PIECE_LINES = 1 << 14


def _line(n: Column) -> Column:
    """The number of a line in its block, from 1."""
    return (n - F.col("first") + 1).alias("line")


def record_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line, text): the records of all files, headers included; block and line say where a record begins.

    A quote that is never closed makes one record of the rest of its file, as it does when a file is read in one piece.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"),
        F.regexp_replace("value", r"\r\z", "").alias("value"),
        F.endswith("value", F.lit("\r")).alias("cr"),
    )
    # the lines of a block are numbered without gaps, so runs of numbers are runs of lines
    lines = lines.withColumn("run", F.floor(F.col("n") / PIECE_LINES))
    inside = W.partitionBy(*PIECE).orderBy("n")
    earlier = inside.rowsBetween(W.unboundedPreceding, -1)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    placed = lines.withColumn("quotes", quotes)
    placed = placed.withColumn("before", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)))
    # one row for each piece of a file: what it adds, and its last line that begins a record, for either state it may begin in
    begins = lambda even: F.max(F.when(F.col("before") % 2 == (0 if even else 1), F.col("n")))
    pieces = placed.groupBy(*PIECE).agg(
        F.sum("quotes").alias("added"), begins(True).alias("last_even"), begins(False).alias("last_odd"), F.min("n").alias("first")
    )
    in_file = W.partitionBy("file").orderBy("block", "run").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.withColumn("first", F.min("first").over(W.partitionBy("file", "block")))
    pieces = pieces.withColumn("odd", F.coalesce(F.sum("added").over(in_file), F.lit(0)) % 2)
    last = F.when(F.col("odd") == 0, F.col("last_even")).otherwise(F.col("last_odd"))
    begun = F.when(last.isNotNull(), F.struct(F.col("block").alias("block"), _line(last)))
    pieces = pieces.withColumn("begun", begun).withColumn("carried", F.last("begun", ignorenulls=True).over(in_file))
    known = placed.join(F.broadcast(pieces.select(*PIECE, "odd", "carried", "first")), PIECE).withColumn("line", _line(F.col("n")))
    opens = F.when((F.col("before") + F.col("odd")) % 2 == 0, F.struct("block", "line"))
    owned = known.withColumn("own", F.coalesce(F.last(opens, ignorenulls=True).over(inside), F.col("carried")))
    part = F.struct("block", "line", "value", "cr")
    records = owned.groupBy("file", "own").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    joined = F.aggregate(
        F.slice("parts", 2, F.size("parts")),
        F.get("parts", F.lit(0)),
        lambda text, p: F.struct(p["block"], p["line"], F.concat(text["value"], F.when(text["cr"], "\r\n").otherwise("\n"), p["value"]).alias("value"), p["cr"]),
    )
    return records.select("file", "own.block", "own.line", joined["value"].alias("text"))


def read_quoted_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header in every file, which must name the columns of ``schema`` in order. Empty lines are left out."""
    kind = T.StructType.fromDDL(schema)
    records = record_texts(spark, path).filter(F.col("text") != "")
    header = (F.col("block") == 0) & (F.col("line") == 1)
    names = ",".join(f'"{f.name}"' for f in kind.fields)
    texts = F.replace("text", F.lit('"'), F.lit(""))
    wrong = records.filter(header & (F.lower(F.regexp_replace(texts, f"\\A{chr(0xFEFF)}", "")) != names.replace('"', "").lower())).select("file", "text").first()
    if wrong:
        raise ValueError(f"{wrong['file']} has the columns {wrong['text']}, not {names}")
    row = F.from_csv("text", F.lit(schema), {"quote": '"', "escape": '"', "multiLine": "true"})
    return records.filter(~header).select(row.alias("row")).select("row.*")
