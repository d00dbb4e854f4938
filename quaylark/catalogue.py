"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from .plans import checks, cycles, geo, indexed, pay, reads, relations, scalars, search, sourcing, texts, words, writes  # noqa: F401
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
