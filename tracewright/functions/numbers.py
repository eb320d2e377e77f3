"""Vector similarity, token prices and effort."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.core import fixed

# Minutes spent on one blocker and USD per hour.
MINUTES_EACH = 5
USD_PER_HOUR = 100


WIDE = "array<double>"


def dot(a: Column, b: Column) -> Column:
    """Dot product in doubles; whole arrays are widened, which is cheaper than widening inside the lambda."""
    products = F.zip_with(a.cast(WIDE), b.cast(WIDE), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v.cast(WIDE), F.lit(0.0), lambda total, x: total + x * x))


def cosine(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine similarity; null when a vector is missing or has no length."""
    return F.try_divide(dot(a, b), norm_a * norm_b)


def weighted_tokens(used: tuple[Column, Column, Column], price: tuple[Column, Column, Column]) -> Column:
    """Tokens in units of output tokens: input counts by its share of the output price."""
    tokens_in, tokens_out, thought = used
    share = (price[0] / 1_000_000) / (price[1] / 1_000_000)
    return (tokens_in * share).cast("bigint") + tokens_out + thought


def cost_thousandths(used: tuple[Column, Column, Column], price: tuple[Column, Column, Column]) -> Column:
    """Cost in 0.001 USD, at least 1. Prices are USD per million tokens."""
    usd = sum((n * (p / 1_000_000) for n, p in zip(used[1:], price[1:])), used[0] * (price[0] / 1_000_000))
    return F.greatest(F.lit(1).cast("bigint"), (usd * 1000).cast("bigint"))


def effort_hours(count: Column) -> Column:
    return count * F.lit(MINUTES_EACH / 60)


def effort_usd(count: Column) -> Column:
    return count * F.lit(MINUTES_EACH / 60) * USD_PER_HOUR


def hours_text(hours: Column) -> Column:
    return F.concat(F.when(hours >= 10, fixed(hours, 0)).otherwise(fixed(hours, 1)), F.lit("h"))


def usd_text(usd: Column) -> Column:
    thousands = F.concat(fixed(usd / 1000, 1), F.lit("K"))
    return F.when(usd >= 1000, thousands).otherwise(usd.cast("bigint").cast("string"))
