"""All registered queries."""

from tracewarden.plans import catalog_rows, catalog_scores, catalog_text, catalog_usage, catalog_vectors  # noqa: F401
from tracewarden.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
