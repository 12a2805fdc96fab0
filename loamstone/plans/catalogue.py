"""All queries of the core, with their DuckDB equivalents."""

from __future__ import annotations

from loamstone.plans import chat, ingest, reading, search, shredding

_MODULES = (search, ingest, chat, reading, shredding)

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE = {name: q for m in _MODULES for name, q in m.ORACLE.items()}
