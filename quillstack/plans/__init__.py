"""The query catalogue: every query by name, and its SQL."""

from __future__ import annotations

from . import choices, curation, features, fitted, hierarchies, learning, lists, measures, pairs, passages, search, stores, texts, views

_PARTS = [lists, texts, measures, curation, learning, search, stores, views, features, choices, pairs, fitted, passages, hierarchies]
QUERIES: dict = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
SQL: dict[str, str] = {name: s for part in _PARTS for name, s in part.SQL.items()}
