"""All queries of the page operators, and their SQL twins."""

from __future__ import annotations

from leafmill.plans import page_queries, parse_queries, store_queries, stream_queries, text_queries, toc_queries, url_queries

MODULES = [url_queries, page_queries, toc_queries, store_queries, text_queries, stream_queries, parse_queries]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
