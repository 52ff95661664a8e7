"""All queries of the engine's own operators, by name, and their SQL for a second engine."""

from __future__ import annotations

from .plans.queries import ORACLE_SQL, QUERIES

#: Ranked full-text search over the knowledge entries.
FLAGSHIP = "search_knowledge"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
