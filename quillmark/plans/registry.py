"""Queries of the engine and the SQL they are held against."""

from __future__ import annotations

from quillmark.plans import chain_queries, file_queries, filing_queries, holding_queries, news_queries, stream_queries
from quillmark.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "chain_queries", "file_queries", "filing_queries", "holding_queries", "news_queries", "stream_queries"]
