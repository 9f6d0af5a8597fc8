"""Registered queries: each operator on the given tables, with its SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sigframe.catalog import (  # noqa: F401  (importing registers the queries)
    aggregates,
    joins,
    learning,
    projections,
    scalars,
    sequences,
    signals,
    storage,
    streams,
)
from sigframe.catalog.registry import REGISTRY


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: entry.run for name, entry in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: entry.sql for name, entry in REGISTRY.items() if entry.sql is not None}
