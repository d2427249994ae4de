"""All core queries and their SQL."""

from __future__ import annotations

from . import queries, raster_queries, source_queries

MODULES = (queries, raster_queries, source_queries)
QUERIES, ORACLE_SQL = queries.QUERIES, queries.ORACLE_SQL
