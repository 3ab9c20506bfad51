"""From raw documents to packed training sequences."""

from __future__ import annotations

from textloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
