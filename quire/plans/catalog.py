"""Registry of the engine's named queries and their SQL oracles."""

from __future__ import annotations

from quire.plans import agents, books, contents, ordering, output, packing, quality, terms, texts, usage

_MODULES = (packing, texts, quality, terms, usage, contents, output, ordering, agents, books)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
