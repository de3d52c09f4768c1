"""All registered queries for the sequence operators and their DuckDB twins."""

from __future__ import annotations

from seqloom.plans import assemblies, clocks, decoding, evaluation, features, files, intervals, rules  # noqa: F401
from seqloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
