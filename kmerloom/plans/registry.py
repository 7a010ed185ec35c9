"""The engine's registered queries and their SQL."""

from __future__ import annotations

from . import index_queries, sequence_queries, source_queries, stream_queries


def queries() -> dict:
    return {n: q for m in (sequence_queries, index_queries, stream_queries, source_queries) for n, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for m in (sequence_queries, index_queries, stream_queries, source_queries) for n, (_, sql) in m.QUERIES.items() if sql}
