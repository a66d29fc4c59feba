"""All registered queries of the library's own operators, and their DuckDB SQL."""

from __future__ import annotations

from . import archives, decisions, ingestion, lists, matching, pricelists, pricing, reading, upkeep

MODULES = (pricing, pricelists, lists, matching, ingestion, archives, decisions, reading, upkeep)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}
