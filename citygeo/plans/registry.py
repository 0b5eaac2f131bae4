"""Registered queries and the SQL that states the same result."""

from __future__ import annotations

from citygeo.plans import file_queries, map_queries, place_queries, world_queries

QUERIES: dict = map_queries.QUERIES | place_queries.QUERIES | world_queries.QUERIES | file_queries.QUERIES
ORACLES: dict = map_queries.ORACLES | place_queries.ORACLES | world_queries.ORACLES | file_queries.ORACLES
