"""All registered queries of the library's own operators."""

from __future__ import annotations

from . import document_queries, interval_queries, review_queries, source_queries, text_queries, track_queries

MODULES = (interval_queries, track_queries, text_queries, review_queries, source_queries, document_queries)
QUERIES = {k: v for m in MODULES for k, v in m.Q.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.S.items() if v}
