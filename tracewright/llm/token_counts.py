"""Token counts of whole texts through a cache of digests.

The cache is a Parquet table of (content, tokenizer, n_tokens): SHA-256 of the normalised text, SHA-256 of the tokenizer file, and the
count. A run digests all texts, looks up the distinct digests, encodes one text for each that is missing, appends the
new counts, and joins every document to its count. Normalising means what the tokenizer drops anyway. Where its file says that white space is
folded and then left out, runs of ASCII white space become one space and ends are trimmed, so texts that differ only so share a cache row;
with any other file the text is digested as it is.

Encoding needs the tokenizer's library on each distinct piece only: where the tokenizer file says that text is normalised (NFC,
white space, lower case), split by a pattern and merged piece by piece, a text's count is the sum over its pieces.
This is used for texts of printable ASCII, Latin-1 letters and common punctuation without special strings, on which those
steps are the same in Python; any other text, and any other tokenizer file, goes to the library whole.

Only ids and digests are shuffled for the look-up; texts are shuffled once, by row, to bring out one of each digest, so a
text that a third of the rows share makes no hot key. Null texts count as empty: 0 bytes, 0 tokens. Rows may repeat.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.base import Workspace, packed, query, row_key, table

LIMIT = 2048
_CACHE = "content string, tokenizer string, n_tokens long"
_PLAIN = r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\xff‐-‧]*"
#: The letters and numbers among those characters, in lower case.
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECES_KEPT = 400_000
_loaded: dict = {}


def by_pieces(spec: dict) -> bool:
    """Whether a tokenizer file says: fold white space, lower the case, and encode each match of a pattern, dropping all between."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    return (
        [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
        and steps[1]["pattern"] == {"Regex": r"\s+"}
        and steps[1]["content"] == " "
        and splits[0].get("type") == "Split"
        and splits[0].get("behavior") == "Removed"
        and bool(splits[0].get("invert"))
        and " " not in splits[0]["pattern"]["Regex"]
        and all(s["type"] == "ByteLevel" and not s["use_regex"] and not s["add_prefix_space"] for s in splits[1:])
        and not spec.get("post_processor")
    )


class Counter:
    """Counts tokens as one tokenizer file gives them; loaded once in each Python process."""

    def __init__(self, data: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import numpy as np
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(data.decode())
        spec = json.loads(data)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.piece = None
        if by_pieces(spec):
            pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\p{L}", _LETTERS).replace(r"\p{N}", _NUMBERS)
            self.piece = re.compile(pattern).findall
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        suffix = spec["model"].get("end_of_word_suffix")
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        self.plain = re.compile(_PLAIN).fullmatch
        self.known: dict[str, int] = {}

    @staticmethod
    def of(data: bytes, digest: str) -> Counter:
        if digest not in _loaded:
            _loaded[digest] = Counter(data)
        return _loaded[digest]

    def whole(self, texts: list[str]) -> list[int]:
        encode = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        return [len(e.ids) for e in encode(texts, add_special_tokens=False)]

    def each(self, pieces: list[str]) -> list[int]:
        """Token counts of pieces, a hundred in one text: the last token of a piece bears the end-of-word mark."""
        import numpy as np

        counts: list[int] = []
        for i in range(0, len(pieces), 100):
            some = pieces[i : i + 100]
            ids = np.array(self.library.encode(" ".join(some), add_special_tokens=False).ids, np.int64)
            last = np.flatnonzero(self.ends[ids])
            whole = len(last) == len(some) and len(ids) == last[-1] + 1
            counts += np.diff(last, prepend=-1).tolist() if whole else self.whole(some)
        return counts

    def count(self, texts: list[str]) -> list[int]:
        fast = self.piece is not None
        direct = [not fast or any(s in t for s in self.special) or not self.plain(t) for t in texts]
        pieces = [[] if d else self.piece(t.lower()) for t, d in zip(texts, direct)]
        new = set().union(*pieces).difference(self.known)
        if new:
            if len(self.known) + len(new) > _PIECES_KEPT:
                self.known.clear()
                new = set().union(*pieces)
            new = list(new)
            self.known.update(zip(new, self.each(new)))
        counts = [sum(map(self.known.__getitem__, p)) for p in pieces]
        rest = [i for i, d in enumerate(direct) if d]
        for i, n in zip(rest, self.whole([texts[i] for i in rest])):
            counts[i] = n
        return counts


def _encoder(data, digest: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(data.value, digest)
        for batch in (b for big in batches for b in packed([big], "text", 1 << 20)):
            counts = counter.count([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(counts, pa.int64())], names=["content", "n_tokens"])

    return run


def normalised(text: Column, tokenizer: bytes) -> Column:
    """What a text is digested as: without the white space that makes no difference to this tokenizer."""
    whole = F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(whole, r"[ \t\n\x0B\f\r]+", " ")) if by_pieces(json.loads(tokenizer)) else whole


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], _CACHE)
    return spark.read.schema(_CACHE).parquet(path)


def count_tokens(docs: DataFrame, tokenizer_file: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; the cache folder at ``cache`` is made or added to.

    One writer at a time. A run that dies before its append has added nothing.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "token-counts")
    with open(tokenizer_file, "rb") as f:
        content = f.read()
    version = hashlib.sha256(content).hexdigest()
    data = spark.sparkContext.broadcast(content)
    narrow = docs.select(docs["doc_id"], docs["text"].cast("string").alias("text"))
    keys = narrow.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        F.sha2(normalised(F.col("text"), content), 256).alias("content"),
        *row_key(F.col("doc_id"), F.col("text")),
    )
    keys = ws.write(keys, "digests")
    stored = read_cache(spark, cache).where(F.col("tokenizer") == version).select("content", F.col("n_tokens"))
    one = keys.groupBy("content").agg(F.min(F.struct("ka", "kb")).alias("k")).join(stored.select("content"), "content", "left_anti")
    texts = narrow.select("text", *row_key(F.col("doc_id"), F.col("text")))
    missing = texts.join(one.select("content", "k.ka", "k.kb"), ["ka", "kb"]).select("content", "text")
    fresh = missing.mapInArrow(_encoder(data, version), "content string, n_tokens long").groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    fresh = ws.write(fresh, "misses")
    fresh.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    counts = stored.join(keys.select("content").distinct(), "content", "left_semi").unionByName(fresh).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    out = keys.join(counts, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    return ws.result(out)


@query("op3_token_counts")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Starts from an empty cache of its own, so that every run does the whole work."""
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    own = Workspace(spark, "token-cache")
    counts = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), f"{own.root}/cache")
    own.close()
    return counts
