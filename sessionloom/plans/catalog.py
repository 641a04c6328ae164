"""All registered queries."""

from sessionloom.plans import queries_basics, queries_candidates, queries_features, queries_models, queries_training  # noqa: F401
from sessionloom.plans.registry import QUERIES

__all__ = ["QUERIES"]
