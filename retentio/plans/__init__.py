"""Registered queries (Spark) and their DuckDB oracle SQL."""

from retentio.plans.registry import QUERIES, ORACLES
from retentio.plans import model_queries  # noqa: F401  (registers model queries)

__all__ = ["QUERIES", "ORACLES"]
