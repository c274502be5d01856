"""Queries by name, and the equivalent SQL."""

from __future__ import annotations

from tamarisk.plans import agent_queries, index_queries, inquiry_queries, retrieval_queries, source_queries, stream_queries, text_queries

QUERIES = {**retrieval_queries.QUERIES, **inquiry_queries.QUERIES, **text_queries.QUERIES, **stream_queries.QUERIES, **agent_queries.QUERIES, **source_queries.QUERIES, **index_queries.QUERIES}
SQL: dict[str, str] = {**retrieval_queries.SQL, **inquiry_queries.SQL, **text_queries.SQL, **stream_queries.SQL, **agent_queries.SQL, **source_queries.SQL, **index_queries.SQL}
