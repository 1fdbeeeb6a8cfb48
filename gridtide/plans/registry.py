"""Registered queries and their DuckDB oracles."""

from __future__ import annotations

from gridtide.plans import anomaly_queries, calendar_queries, evaluation_queries, feature_queries, grid_queries

PARTS = (grid_queries, calendar_queries, feature_queries, evaluation_queries, anomaly_queries)
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in PARTS for name, sql in part.ORACLE_SQL.items()}
