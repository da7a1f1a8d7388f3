"""All registered queries."""

from __future__ import annotations

from riskweave.plans import (  # noqa: F401  (imports register the queries)
    data_queries,
    experiment_queries,
    feature_queries,
    model_fact_queries,
    model_queries,
    score_queries,
)
from riskweave.plans.registry import EXPECTED_SQL, QUERIES

__all__ = ["EXPECTED_SQL", "QUERIES"]
