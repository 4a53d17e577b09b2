"""The register of all core queries and of their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kgloom.plans import kg_queries, more_queries, nested_queries, page_queries, stage_queries, text_queries

MODULES = (nested_queries, text_queries, kg_queries, page_queries, more_queries, stage_queries)
FLAGSHIP = "p1_found"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All core queries by name."""
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    """The SQL twins of core queries."""
    out: dict[str, str] = {}
    for m in MODULES:
        out |= m.SQL
    return out
