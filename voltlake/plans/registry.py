"""Where queries and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voltlake.plans import bindings as b

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Query, ctes: list[str] | None = None, select: str | None = None, doubles: str = "", others: str = "", digits: int = 4) -> None:
    """The query, rounded; and, if `select` is given, its oracle: the named columns of it, doubles rounded alike."""
    QUERIES[name] = lambda spark, sf_dir: b.rounded(query(spark, sf_dir), digits)
    if select:
        columns = [c for c in others.split()] + [f"round({c}, {digits}) + 0.0 AS {c}" for c in doubles.split()]
        ORACLES[name] = (f"WITH {', '.join(ctes)} " if ctes else "") + f"SELECT {', '.join(columns)} FROM ({select})"
