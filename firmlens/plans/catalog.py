"""Importing the plan modules fills the registry."""

from firmlens.plans import document_queries, firm_queries, panel_queries, retrieval_queries, source_queries, stat_queries, unit_queries  # noqa: F401
from firmlens.plans.registry import ORACLES, QUERIES  # noqa: F401
