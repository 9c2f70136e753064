"""All named queries."""

from . import archive_queries, misc_queries, review_queries, rhythm_queries, search_queries, session_queries, source_queries, stream_queries, usage_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
