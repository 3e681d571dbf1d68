"""All queries of the library."""

from lattica.plans import build_queries, control_queries, graph_queries, text_queries  # noqa: F401  entering them
from lattica.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
