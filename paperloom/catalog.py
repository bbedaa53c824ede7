"""All queries over the supplied tables, by name, with their DuckDB SQL."""

from __future__ import annotations

from .plans import joins, records, scans
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "joins", "records", "scans"]
