"""Registered queries over the given tables."""

from rollbook.queries import audit, batches, build, filters, findings, phases, retrieval, statistics  # noqa: F401
from rollbook.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
