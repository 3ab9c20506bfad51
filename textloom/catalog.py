"""All queries by name, and the SQL that checks them."""

from __future__ import annotations

from textloom.plans import oracles, queries, state

QUERIES = queries.QUERIES | state.QUERIES
ORACLES: dict[str, str] = oracles.ORACLES | state.ORACLES
FLAGSHIP = "hybrid_rrf"
