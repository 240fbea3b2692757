"""Every registered query with its DuckDB equivalent."""

from __future__ import annotations

from tallyhawk.plans import core_queries, file_queries, rule_queries, support_queries

_MODULES = (core_queries, rule_queries, support_queries, file_queries)
QUERIES: dict = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
