"""Registry of queries: each has a DataFrame form, the operators it exercises, and DuckDB SQL for the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    operators: tuple[str, ...]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, operators: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) as a query; ``operators`` are the inventory's ids, space-separated."""

    def add(f):
        assert name not in REGISTRY, name
        REGISTRY[name] = Query(name, f, tuple(operators.split()), sql)
        return f

    return add
