"""Registered queries: the operators on the driver's tables, each next to its SQL counterpart."""

from silverprint.parity import catalog, discovery, duplicates, records, streams  # noqa: F401
from silverprint.parity.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
