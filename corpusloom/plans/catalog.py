"""Registry of the engine's queries and their DuckDB counterparts."""

from __future__ import annotations

from . import api, graph_queries, page_queries, run_queries, search_queries

QUERIES = search_queries.QUERIES | page_queries.QUERIES | graph_queries.QUERIES | api.QUERIES | run_queries.QUERIES
ORACLES = search_queries.ORACLES | page_queries.ORACLES | graph_queries.ORACLES | api.ORACLES | run_queries.ORACLES
