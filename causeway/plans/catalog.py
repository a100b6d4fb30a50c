"""All registered queries and their SQL oracles."""

from __future__ import annotations

from causeway.plans.registry import ORACLES, QUERIES
from causeway.plans import (  # noqa: F401  (imported to register their queries)
    catalog_advice,
    catalog_evaluation,
    catalog_graph,
    catalog_inference,
    catalog_learners,
    catalog_tables,
    catalog_votes,
)

__all__ = ["ORACLES", "QUERIES"]
