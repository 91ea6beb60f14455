"""Queries and their oracle SQL, collected from the plan modules."""

from __future__ import annotations

from filingspark.plans import assembled, documents, filings

MODULES = (filings, documents, assembled)
QUERIES: dict = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
