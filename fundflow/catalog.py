"""Registry of named queries: Spark callables and their independent SQL oracles.

Each callable takes (spark, sf_dir) and returns a DataFrame over the whole bound
tables. Oracle SQL runs in DuckDB over the same parquet base tables.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def _load() -> None:
    # importing the modules registers their queries
    from fundflow.plans import registered  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
