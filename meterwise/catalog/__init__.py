"""Registered queries: each one pairs a Spark callable with an optional DuckDB statement."""

from collections.abc import Callable
from functools import wraps
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from meterwise.session import tune

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}
_PARTS = [
    "cleaning", "ingest", "zones", "sampling", "outliers", "features", "profiling", "segments",
    "modelling",
]


def query(name: str, sql: str | None = None):
    """Register a query function under ``name`` together with its equivalent SQL."""

    def register(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query name: {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return register


def all_queries() -> dict[str, QueryFn]:
    _load()
    return {name: _tuned(fn) for name, fn in _QUERIES.items()}


def _tuned(fn: QueryFn) -> QueryFn:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    return run


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    for part in _PARTS:
        import_module(f"meterwise.catalog.{part}")
