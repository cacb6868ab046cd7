"""The operators bound to the given tables, as named queries with their SQL."""

from . import alerts, dashboard, drift, flows, lifecycle, metrics, quality, streams, training  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
