"""All queries of the package but those of the training-data operators."""

from __future__ import annotations

from . import analytics, field_queries, file_queries, lead_queries, ledger_queries, more_queries, place_queries, rule_queries  # noqa: F401  they register their queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
