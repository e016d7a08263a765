"""How plans register a query with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.mapping import Catalogue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of a Catalogue under its name."""

    def register(f: Callable[[Catalogue], DataFrame]) -> Callable[[Catalogue], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Catalogue(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register
