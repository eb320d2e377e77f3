"""All registered queries of the subpackage."""

from tracewright.llm import (  # noqa: F401
    bpe_tree,
    chat_format,
    decontaminate,
    hard_negatives,
    language_id,
    minhash_dedup,
    periodic_runs,
    pivot_search,
    ppm,
    quality_rules,
    substring_dedup,
    token_counts,
    toxicity,
)
from tracewright.llm.base import REGISTRY

__all__ = ["REGISTRY"]
