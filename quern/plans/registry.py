"""All queries of the engine and their SQL."""

from __future__ import annotations

from . import algebra_queries, graph_queries, learning_queries, metrics_queries, tables_queries  # noqa: F401
from .common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
