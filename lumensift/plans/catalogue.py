"""All registered queries; importing a query module registers its entries."""

from __future__ import annotations

from lumensift.plans.registry import ORACLES, QUERIES
from lumensift.plans import adjudication_queries, cadence_queries, candidate_queries, catalog_queries, detrend_queries, gate_queries, injection_queries, model_queries, quota_queries, recovery_queries, review_queries, scalar_queries, search_queries, selection_queries, training_queries  # noqa: F401

__all__ = ["QUERIES", "ORACLES", "flagship"]


def flagship(spark, sf_dir):
    """Clean, search, consolidate, vet."""
    return QUERIES["flagship_search"](spark, sf_dir)
