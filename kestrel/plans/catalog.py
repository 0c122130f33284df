"""All queries on the reference's own operators."""

from __future__ import annotations

from kestrel.plans import agreement_queries, array_queries, score_queries, series_queries, source_queries, stats_queries, stream_queries, text_queries  # noqa: F401
from kestrel.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
