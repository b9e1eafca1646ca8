"""Queries by operator, with their SQL twins for another engine."""

from __future__ import annotations

from tidemark.queries import evidence, ingestion, market, quality, research, spec, tables, trading

MODULES = (market, quality, research, spec, tables, ingestion, evidence, trading)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
