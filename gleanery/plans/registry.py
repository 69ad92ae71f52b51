"""All registered queries and their SQL."""

from __future__ import annotations

from . import audit_queries, context_queries, evaluation_queries, index_queries, retrieval_queries, scan_queries, source_queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for module in (scan_queries, index_queries, retrieval_queries, evaluation_queries, context_queries, audit_queries, source_queries):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
