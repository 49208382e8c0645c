"""Registered queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from runlens.session import configure

Query = Callable[[SparkSession, str], DataFrame]

_AREAS = ("journal", "runs", "metrics", "keyed", "logs", "catalog", "completion", "checks", "streams")


def _areas():
    return [import_module(f"runlens.queries.{name}") for name in _AREAS]


def _configured(query: Query) -> Query:
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(configure(spark), sf_dir)

    call.__doc__ = query.__doc__
    return call


def all_queries() -> dict[str, Query]:
    return {
        name: _configured(query) for area in _areas() for name, query in area.QUERIES.items()
    }


def all_sql() -> dict[str, str]:
    return {name: text for area in _areas() for name, text in area.SQL.items()}
