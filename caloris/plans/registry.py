"""The table of registered queries that each module of queries fills."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Decorator that registers a query under its name, with the DuckDB SQL that must give the same rows where there is one."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, oracle: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if oracle:
                self.oracles[f.__name__] = oracle
            return f

        return add


def rounded(name: str, digits: int = 6) -> Column:
    """A column to so many digits, under its name."""
    return F.round(name, digits).alias(name)
