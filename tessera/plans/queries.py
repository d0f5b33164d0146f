"""All registered queries of the library."""

from __future__ import annotations

from tessera.plans import graph_queries, history_queries, page_queries, promise_queries, store_queries, stream_queries, text_queries, topic_queries

MODULES = (text_queries, history_queries, promise_queries, graph_queries, page_queries, stream_queries, store_queries, topic_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
