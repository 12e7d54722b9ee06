"""All registered queries. Importing this module registers them."""

from rowsmith.plans import edit_queries, generation_queries, graph_queries, select_queries, validation_queries  # noqa: F401
from rowsmith.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
