"""All registered queries."""

from docketry.plans import (  # noqa: F401
    case_queries,
    extract_queries,
    intake_queries,
    serve_queries,
    state_queries,
    upkeep_queries,
    value_queries,
)
from docketry.plans.registry import QUERIES

__all__ = ["QUERIES"]
