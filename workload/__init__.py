"""Registered queries over the given tables, each next to its SQL twin."""

from workload import (  # noqa: F401
    alert_queries,
    corpus_queries,
    distribution_queries,
    listing_queries,
    plan_queries,
    rollup_queries,
    source_queries,
    stream_queries,
)
from workload.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
