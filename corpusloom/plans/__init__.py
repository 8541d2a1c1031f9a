"""Registered queries and their SQL."""

from corpusloom.plans import review_queries, workflow_queries  # noqa: F401  (they register their queries)
from corpusloom.plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
