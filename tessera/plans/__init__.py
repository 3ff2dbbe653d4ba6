"""Registered queries over the driver's tables."""

from . import evaluation_queries, graph_queries, memory_queries, report_queries, retrieval_queries, scan_queries, state_queries, stream_queries, text_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "evaluation_queries", "graph_queries", "memory_queries", "report_queries", "retrieval_queries", "scan_queries", "state_queries", "stream_queries", "text_queries"]
