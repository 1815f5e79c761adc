"""Every query of the library by name, and its SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import matching_queries, row_queries, session_queries, sheet_queries

FLAGSHIP = "q_match_cascade"
_MODULES = [matching_queries, row_queries, session_queries, sheet_queries]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.SQL.items()}
