"""Queries of the engine by name, each with its SQL twin."""

from __future__ import annotations

from . import audit, documents, evaluation, retrieval, stateful  # noqa: F401  they register their queries
from .base import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
