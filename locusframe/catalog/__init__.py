"""Registered queries with their checks."""

from locusframe.catalog import (  # noqa: F401
    chunk_queries,
    plan_queries,
    record_queries,
    vector_queries,
)
from locusframe.catalog.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
