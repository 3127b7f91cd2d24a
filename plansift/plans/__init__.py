"""Registered queries with their SQL."""

from plansift.plans import costing, documents, registry, state  # noqa: F401
from plansift.plans.base import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "budget_totals"
