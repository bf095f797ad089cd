"""All registered queries and oracles."""

from . import data_queries, graph_queries, infer_queries, more_queries, search_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
