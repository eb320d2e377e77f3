"""A training corpus from raw documents: toxic text out, near duplicates out, repeated passages cut, benchmark text out, encoded.

Each stage takes (spark, docs, folder of tables) and works on all rows its predecessor kept; every stage but the last returns the columns of
``documents``, extra ones included, whatever their names.

Null and empty texts have no words, no shingles and no tokens: they are scored like a text without any feature, are copies of nothing, lose
nothing, hold no benchmark passage, and come out with 0 tokens. Very long texts are read whole, in pieces where one row would be too large. Rows
that repeat an id: each is scored; of rows with one id that is kept, the near-duplicate stage keeps one; a row without id is compared by its
text. Ties go to the smaller id. Equal rows are one group of copies. An empty table gives no rows, and a missing label table's rows none to learn
from: then nothing is toxic. The last stage adds n_tokens, ids_sha256 and decoded_sha256 in place of the text; columns that had these names
are replaced by them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.base import Query, Workspace, table
from tracewright.llm.bpe_tree import encode_and_decode
from tracewright.llm.decontaminate import drop_contaminated
from tracewright.llm.minhash_dedup import keep_one_of_each
from tracewright.llm.substring_dedup import remove_repeats
from tracewright.llm.toxicity import drop_toxic
from tracewright.session import tune


def toxicity(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return drop_toxic(docs, table(tune(spark), folder, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    tune(spark)
    return keep_one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    tune(spark)
    cut = remove_repeats(docs)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return drop_contaminated(docs, table(tune(spark), folder, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    import public_tokenizers

    tune(spark)
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_and_decode(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: No SQL: the classifier and the byte-pair merges cannot be said in it.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages on ``documents``, each written and read again in the shared folder."""
    ws = Workspace(spark, "pipeline")
    docs, before = table(spark, folder, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = ws.write(stage(spark, docs, folder), name)
        if before is not None:
            ws.drop(before)
        before = docs
    name, stage = STAGES[-1]
    return ws.result(stage(spark, docs, folder), name)  # goes when the driver's process ends


QUERY = Query(run, ORACLE_SQL)
