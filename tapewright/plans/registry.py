"""Registered queries: a Spark function, its SQL twin and the inventory rows it covers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None
    covers: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def query(covers: str, sql: str | None = None, name: str | None = None) -> Callable[[Run], Run]:
    """Register a query under its function name. Without ``sql`` a pytest fixture checks it."""

    def register(run: Run) -> Run:
        key = name or run.__name__
        if key in REGISTRY:
            raise ValueError(f"query {key!r} is registered twice")
        REGISTRY[key] = Query(key, run, sql, tuple(covers.split()))
        return run

    return register
