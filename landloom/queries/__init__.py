"""Registered queries by operator id, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES = ("change", "grids", "projections", "accuracy", "samples", "parcels", "rasters", "runs", "io")


def query(sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) under its name; ``sql`` is its oracle.

    Names of derived tables in the SQL, as ``{class_pair}``, become subqueries.
    """

    def register(f: Callable) -> Callable:
        from landloom.sources.derived import expanded

        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = expanded(sql)
        return f

    return register


def load() -> None:
    """Import all query modules."""
    for name in MODULES:
        import_module(f"landloom.queries.{name}")
