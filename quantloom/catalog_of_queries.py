"""All registered queries and their oracles."""

from __future__ import annotations

from quantloom.plans import desk_queries, evaluation_queries, panel_queries, record_queries
from quantloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "desk_queries", "evaluation_queries", "panel_queries", "record_queries"]
