"""Registry of the catalogue queries and their DuckDB equivalents."""

from __future__ import annotations

from . import analytics, indexes, scalars, search, stored

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (search, scalars, analytics, stored, indexes):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
