"""All registered queries: a name, a function (spark, sf_dir) -> DataFrame, and the oracle's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated function; sql is what DuckDB must return the same rows for."""

    def keep(f: Query) -> Query:
        assert name not in _QUERIES, name
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = sql
        return f

    return keep


def oracle_of(name: str) -> str:
    """The oracle of a query that is already registered."""
    return _ORACLES[name]


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def _load() -> None:
    from importlib import import_module

    for module in MODULES:
        import_module(f"severa.plans.{module}")


MODULES = ["stats", "rows", "merging", "reports", "events", "outlook", "linkage", "sources", "more", "serving", "ingest", "matching", "survival", "incremental", "report"]
