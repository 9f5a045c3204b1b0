"""Registered queries of the analytics operators and their DuckDB equivalents.

Outputs that pass through sums or transcendental functions are rounded on both
sides, as the order of additions differs between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Add a query under an inventory id, with its SQL if there is one."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """``df`` with every double column rounded."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def queries() -> dict[str, Callable]:
    """Every analytics query, by inventory id."""
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """The SQL equivalents, by inventory id."""
    _load()
    return dict(ORACLES)


def _load() -> None:
    from . import queries_basic, queries_graph, queries_metrics, queries_models  # noqa: F401
