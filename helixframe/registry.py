"""Registered queries of the engine's own operators."""

from __future__ import annotations

from .plans import sequence_queries, vector_queries


def queries() -> dict:
    return {**vector_queries.QUERIES, **sequence_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**vector_queries.SQL, **sequence_queries.SQL}
