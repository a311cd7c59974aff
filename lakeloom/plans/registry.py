"""Registered queries: name -> (Spark function, DuckDB SQL or None)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        assert name not in _QUERIES, name
        _QUERIES[name] = (f, oracle)
        return f

    return add


def _load() -> None:
    for part in ("relational", "functions", "windows", "nested", "changes", "analysis"):
        importlib.import_module(f"lakeloom.plans.queries_{part}")


def queries() -> dict[str, Query]:
    _load()
    return {k: f for k, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: sql for k, (_, sql) in _QUERIES.items() if sql}


def dialect(name: str, text: str, oracle: str | None = None) -> None:
    """A query that is one statement of the dialect; ``oracle`` where DuckDB wants another text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from lakeloom.plans.engine import Engine

        return Engine(spark, sf_dir).sql(text)

    run.text = text
    register(name, oracle or text)(run)
