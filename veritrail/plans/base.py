"""Registration of queries with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..runtime import table

Query = Callable[[SparkSession, str], DataFrame]


class Plans:
    """Queries by name, each with its SQL where SQL can express it."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
        """Register a function of a table getter under its name."""

        def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self.queries[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return register
