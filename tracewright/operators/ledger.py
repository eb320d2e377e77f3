"""Users, their requests and what the model calls behind them cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.numbers import cost_thousandths, weighted_tokens
from tracewright.operators.ordering import ordered_chunks
from tracewright.schemas import pricing_table

CALL = ["id", "usage_log_id", "llm_model", "tokens_used", "cost_usd_thousandths", "created_at"]
#: Calls of one request that are listed in one row while they are cut into chunks.
LIST = 10_000


def user_list(users: DataFrame) -> DataFrame:
    return users.select("id", "username", "email", "name", "avatar_url", "is_active")


def usage_rows(logs: DataFrame, users: DataFrame, calls: DataFrame) -> DataFrame:
    """One row per request and model call; requests without calls have null call columns."""
    who = users.select(*[F.col(c).alias(f"user_{c}") for c in user_list(users).columns])
    call = calls.select(*[F.col(c).alias(f"call_{c}") for c in CALL])
    return logs.join(who, "user_id").join(call, F.col("id") == F.col("call_usage_log_id"), "left")


def usage_totals(logs: DataFrame, users: DataFrame, calls: DataFrame) -> DataFrame:
    """Per request: its user, the number of calls, tokens and cost.

    Calls are totalled before the join, so a request with very many calls is combined map-side.
    """
    per_log = calls.groupBy(F.col("usage_log_id").alias("id")).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("tokens_used").alias("tokens_used"),
        F.sum("cost_usd_thousandths").alias("cost_usd_thousandths"),
    )
    who = users.select(F.col("id").alias("user_id"), "username", "name")
    joined = logs.join(who, "user_id").join(per_log, "id", "left")
    return joined.fillna(0, ["calls", "tokens_used", "cost_usd_thousandths"])


def newest_first(report: DataFrame) -> DataFrame:
    return report.orderBy(F.desc("created_at"), F.desc("id"))


def call_lists(calls: DataFrame, chunk: int, most: int = LIST) -> DataFrame:
    """(usage_log_id, chunk, items): the calls of each request in order, at most ``chunk`` to a row.

    Requests with up to ``most`` calls are listed by one aggregation and cut in place; the few with more go through the sorted table, so that no list
    grows with the data.
    """
    key, call = "usage_log_id", F.struct(*[F.col(c) for c in CALL])
    long = calls.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(key)
    some = not long.isEmpty()
    short = calls.join(long, key, "left_anti") if some else calls
    lists = short.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(call)).alias("calls"))  # by id, their first field
    starts = F.sequence(F.lit(0), F.floor((F.size("calls") - 1) / chunk).cast("int"))
    cut = F.transform(starts, lambda k: F.struct(k.cast("bigint").alias("chunk"), F.slice("calls", k * chunk + 1, F.lit(chunk)).alias("items")))
    rows = lists.select(key, F.inline(cut))
    if some:
        rest = ordered_chunks(calls.join(long, key, "left_semi"), [key], ["id"], call, chunk)
        rows = rows.unionByName(rest.select(key, "chunk", "items"))
    return rows


def nested_usage(logs: DataFrame, users: DataFrame, calls: DataFrame, chunk: int = 500) -> DataFrame:
    """Requests as ``struct(user), struct(usage_log), array(llm_calls)``.

    A request with more calls than ``chunk`` continues in further rows, numbered by ``chunk``; one without calls
    has an empty list.
    """
    lists = call_lists(calls, chunk)
    who = users.select(F.col("id").alias("user_id"), F.struct(*user_list(users).columns).alias("user"))
    log = F.struct(*[F.col(c) for c in logs.columns]).alias("usage_log")
    requests = logs.select("id", "user_id", "created_at", log).join(who, "user_id")
    joined = requests.join(lists.withColumnRenamed("usage_log_id", "id"), "id", "left")
    empty = F.array().cast(lists.schema["items"].dataType)
    return joined.select(
        "id",
        "created_at",
        "user",
        "usage_log",
        F.coalesce("chunk", F.lit(0).cast("bigint")).alias("chunk"),
        F.coalesce("items", empty).alias("llm_calls"),
    )


def logs_by_username(logs: DataFrame, users: DataFrame, username: str | None = None) -> DataFrame:
    """Requests with the name of who made them; of one user when a name is given."""
    who = users.select(F.col("id").alias("user_id"), "username")
    if username is not None:
        who = who.filter(F.col("username") == username)
    return logs.join(who, "user_id")


def price_calls(calls: DataFrame) -> DataFrame:
    """Ledger rows of model calls; models without a price give none.

    The price list is a fixed handful of rows. A missing count is 0.
    """
    count = lambda path: F.coalesce(F.col(path), F.lit(0).cast("bigint"))
    used = (
        count("usage_metadata.input_tokens"),
        count("usage_metadata.output_tokens"),
        count("usage_metadata.output_token_details.reasoning"),
    )
    price = (F.col("input_per_million"), F.col("output_per_million"), F.col("reasoning_per_million"))
    priced = calls.filter(F.col("usage_log_id").isNotNull() & F.col("usage_metadata").isNotNull()).join(
        F.broadcast(pricing_table(calls.sparkSession)), F.col("llm_model") == F.col("model")
    )
    kept = [c for c in calls.columns if c != "usage_metadata"]
    return priced.select(
        *kept,
        weighted_tokens(used, price).alias("tokens_used"),
        cost_thousandths(used, price).alias("cost_usd_thousandths"),
    )


def cost_by_model(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("llm_model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("tokens_used").alias("tokens_used"),
        F.sum("cost_usd_thousandths").alias("cost_usd_thousandths"),
    )
