"""The registered queries over the given tables, each with its SQL where SQL can express it."""

from . import audit_queries, gate_queries, graph_queries, link_queries, metric_queries, repair_queries, search_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
