"""Registered queries: the engine's operators over the given tables, each with its SQL twin where SQL can say it."""

from tracewright.workloads import deploys, diffs, events, ingest, misc, ranking, readers, reviews, sources, state, usage  # noqa: F401
from tracewright.workloads.base import REGISTRY, Query

__all__ = ["REGISTRY", "Query"]
