"""Ranking the changes linked to an issue by vector similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.numbers import cosine, norm
from tracewright.functions.text import candidate_card
from tracewright.operators.ordering import rank_slice

PAGE = 25
#: Issues and changes of a cell; with wide vectors a few MB.
BLOCK = 512
ISSUE = ["repo_id", "issue_id"]
PULL = ["repo_id", "pull_request_id"]
CELL = ["repo_id", "issue_block", "pull_block"]
#: Bytes of one side's linked vectors, as measured, up to which they go to every executor; the driver holds a few times as much for a while.
SENT = 128 << 20


def with_embedding(pull_requests: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Changes with their embedding, null where there is none."""
    vectors = embeddings.select("repo_id", F.col("pull_request_id").alias("id"), "embedding")
    return pull_requests.join(vectors, ["repo_id", "id"], "left")


def issue_candidates(links: DataFrame, pull_requests: DataFrame, embeddings: DataFrame) -> DataFrame:
    """The changes linked to each issue, with their embedding."""
    known = with_embedding(pull_requests, embeddings).withColumnRenamed("id", "pull_request_id")
    return links.select(*ISSUE, "pull_request_id").join(known, PULL)


def without_cherry_picks(pull_requests: DataFrame) -> DataFrame:
    return pull_requests.filter(~F.contains(F.lower("title"), F.lit("cp staging")))


def _prepared(vectors: DataFrame, key: str) -> DataFrame:
    """(repo_id, key, vector, norm) of the vectors there are; norms are taken once per vector."""
    known = vectors.filter(F.col("embedding").isNotNull())
    return known.select("repo_id", key, F.col("embedding").alias("vector"), norm(F.col("embedding")).alias("norm"))


def _broadcast_limit(df: DataFrame) -> int:
    """Spark's own limit; negative where broadcasts are switched off."""
    return df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def _fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark's own estimate is below its broadcast limit."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= _broadcast_limit(df)


def _linked(vectors: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The vectors that some pair needs."""
    return vectors.join(pairs.select(*keys).distinct(), keys, "left_semi")


def _can_be_sent(vectors: DataFrame) -> bool:
    """Whether the vectors, as measured, are few enough for every executor to hold them all."""
    width = 8 if isinstance(vectors.schema["vector"].dataType.elementType, T.DoubleType) else 4
    return (vectors.agg(F.sum(F.size("vector") * width + 64)).first()[0] or 0) <= SENT


def score_links(links: DataFrame, issue_vectors: DataFrame, pull_vectors: DataFrame, block: int | None = None) -> DataFrame:
    """Cosine similarity of every linked pair; only keys and the score leave this step.

    Vectors that Spark can broadcast are joined in place. Beyond that, the side whose linked vectors are few (``SENT``) goes to every executor
    and the other side meets the pairs by its key, so each of its vectors is shuffled once, however many links it has, and the scoring is
    spread by that key. Where neither side is small, or with ``block``, links are laid out in cells (see ``score_in_cells``).
    """
    issue, pull = _prepared(issue_vectors, "issue_id"), _prepared(pull_vectors, "pull_request_id")
    pairs = links.select(*ISSUE, "pull_request_id")
    if not block and _fits_broadcast(issue_vectors) and _fits_broadcast(pull_vectors):
        return score_by_joins(pairs, issue, pull)
    if not block and _broadcast_limit(pairs) >= 0:
        few = _linked(issue, pairs, ISSUE)
        if _can_be_sent(few):
            return score_by_joins(pairs, F.broadcast(few), pull.hint("merge"))
        few = _linked(pull, pairs, PULL)
        if _can_be_sent(few):
            return score_by_joins(pairs, issue.hint("merge"), F.broadcast(few), issues_first=True)
    return score_in_cells(pairs, issue, pull, block or BLOCK)


def score_by_joins(pairs: DataFrame, issue: DataFrame, pull: DataFrame, issues_first: bool = False) -> DataFrame:
    """Scores of pairs by two joins; what is joined first may be shuffled, as the pairs are still narrow."""
    named = lambda df, name: df.withColumnsRenamed({"vector": f"{name}_vector", "norm": f"{name}_norm"})
    sides = [(named(pull, "pull"), PULL), (named(issue, "issue"), ISSUE)]
    joined = pairs
    for vectors, keys in reversed(sides) if issues_first else sides:
        joined = joined.join(vectors, keys)
    similarity = cosine(F.col("issue_vector"), F.col("pull_vector"), F.col("issue_norm"), F.col("pull_norm"))
    return joined.select(*ISSUE, "pull_request_id", similarity.alias("score"))


def in_cells(pairs: DataFrame, issue_blocks: int, pull_blocks: int) -> DataFrame:
    """Pairs with their cell: the blocks that their issue and their change fall in by hash."""
    place = lambda key, n: F.pmod(F.xxhash64("repo_id", key), F.lit(n)).cast("int")
    return pairs.withColumns({"issue_block": place("issue_id", issue_blocks), "pull_block": place("pull_request_id", pull_blocks)})


def vectors_of_cells(cells: DataFrame, vectors: DataFrame, key: str, name: str) -> DataFrame:
    """Each cell with the vectors its pairs need, once each, however many pairs need them."""
    wanted = cells.select(*CELL, key).distinct().join(vectors, ["repo_id", key])
    entries = F.sort_array(F.collect_list(F.struct(F.col(key).alias("id"), "vector", "norm")))
    return wanted.groupBy(*CELL).agg(entries.alias(name))


def score_in_cells(pairs: DataFrame, issue: DataFrame, pull: DataFrame, block: int) -> DataFrame:
    """Scores of distinct pairs by cells of about ``block`` issues and ``block`` changes.

    A vector is sent to each cell of its block's row or column that needs it, so the bytes shuffled grow with vectors and cells, not with the
    links of a change. Pairs and both lists of vectors meet by cell, without another exchange; a cell's lists are bounded by the block, so a
    change that every issue links to only takes part in more cells.
    """
    blocks = [max(1, -(-df.count() // block)) for df in (issue, pull)]
    cells = in_cells(pairs.distinct(), *blocks)
    listed = cells.groupBy(*CELL).agg(F.collect_list(F.struct("issue_id", "pull_request_id")).alias("pairs"))
    sides = vectors_of_cells(cells, issue, "issue_id", "issues"), vectors_of_cells(cells, pull, "pull_request_id", "pulls")
    whole = listed.join(sides[0], CELL).join(sides[1], CELL)
    whole = whole.withColumns({"issue_ids": F.col("issues.id"), "pull_ids": F.col("pulls.id")})

    def scored(pair: Column) -> Column:
        at = F.array_position("issue_ids", pair["issue_id"]), F.array_position("pull_ids", pair["pull_request_id"])
        a, b = F.get("issues", at[0].cast("int") - 1), F.get("pulls", at[1].cast("int") - 1)
        known = (at[0] > 0) & (at[1] > 0)
        score = F.when(known, cosine(a["vector"], b["vector"], a["norm"], b["norm"]))
        return F.struct(pair["issue_id"].alias("issue_id"), pair["pull_request_id"].alias("pull_request_id"), known.alias("known"), score.alias("score"))

    rows = whole.select("repo_id", F.inline(F.transform("pairs", scored)))
    return rows.where("known").select(*ISSUE, "pull_request_id", "score")


def top_page(scored: DataFrame, page: int = 0, size: int = PAGE) -> DataFrame:
    """One page of each issue's candidates, best first; equal scores go by number.

    Pairs without a score rank last and are taken out afterwards: a filter before the ranking would be merged
    into the join and make it compute every score twice.
    """
    order = [F.desc("score"), F.asc("pull_request_id")]
    rated = scored.withColumn("score", F.nanvl("score", F.lit(None).cast("double")))
    ranked = rank_slice(rated, ISSUE, order, page * size + 1, (page + 1) * size, ["pull_request_id"])
    return ranked.filter(F.col("score").isNotNull())


def candidate_blocks(ranked: DataFrame, pull_requests: DataFrame) -> DataFrame:
    """The cards of one page of candidates as a single text per issue, in rank order."""
    details = pull_requests.withColumnRenamed("id", "pull_request_id")
    card = candidate_card(
        F.col("pull_request_id"),
        F.col("title"),
        F.col("test"),
        F.col("files"),
        F.col("code_diff_summary"),
        F.col("score"),
        F.col("explanation"),
    )
    cards = ranked.join(details, PULL).select(*ISSUE, F.struct("rank", card.alias("card")).alias("entry"))
    # a page holds at most PAGE cards, so the list is bounded
    listed = cards.groupBy(*ISSUE).agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    texts = F.transform("entries", lambda e: e["card"])
    return listed.select(*ISSUE, F.size("entries").alias("candidates"), F.array_join(texts, "\n\n").alias("block"))
