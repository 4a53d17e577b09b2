"""Operators for training-data pipelines; nothing else in the library imports them."""

from __future__ import annotations

from kgloom.llm import registry  # a missing library fails here, so the whole part is switched off


def queries() -> dict:
    """All queries of this subpackage."""
    return registry.QUERIES


def oracle_sql() -> dict[str, str]:
    """Their SQL twins."""
    return registry.SQL
