"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from .queries import golden, pages, sites, texts

_MODULES = (pages, sites, texts, golden)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
