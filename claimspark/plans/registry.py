"""Registered queries over the driver tables, and the SQL that must give the same rows."""

from __future__ import annotations

from . import data_queries, flow_queries, metric_queries, task_queries, text_queries
from .metric_queries import flagship

_MODULES = (text_queries, data_queries, metric_queries, task_queries, flow_queries)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}

__all__ = ["ORACLES", "QUERIES", "flagship"]
