"""All registered queries."""

from . import (  # noqa: F401
    burst_queries, campaign_queries, check_queries, correlation_queries, feed_queries, model_queries, normalize_queries, pair_queries,
    report_queries, stream_queries,
)
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
