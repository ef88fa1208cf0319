"""All queries of the engine by name, with the SQL that checks them."""

from __future__ import annotations

from tessera.plans import queries_reason, queries_search, queries_text, queries_updates
from tessera.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "queries_reason", "queries_search", "queries_text", "queries_updates"]
