"""Registered queries and their DuckDB counterparts.

Every query derives its input from the given tables with Spark, over whole tables and whole texts.
"""
from .registry import ORACLES, QUERIES
from . import (  # noqa: F401  (modules register themselves)
    q_expressions, q_facets, q_jobs, q_keywords, q_pages, q_quality, q_reports, q_sites,
)

__all__ = ["QUERIES", "ORACLES"]
