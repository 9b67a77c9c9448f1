"""Registered queries: one per operator family of the survey, each a
``(spark, sf_dir) -> DataFrame`` over the driver's tables, with its DuckDB
oracle SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn
    return deco


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    # Importing the modules runs their @register decorators.
    from basketry.plans import (q_boost, q_clean, q_encode, q_evaluate, q_features,  # noqa: F401
                                q_profile, q_series)
