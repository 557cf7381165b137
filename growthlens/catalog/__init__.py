"""Registered queries: name -> (Spark query, DuckDB SQL or None)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .base import REGISTRY

AREAS = (
    "site", "audit", "changes", "search", "answers", "web", "ads", "content", "leads", "ops", "copy", "reports", "streams", "sitemaps", "records",
)


def _load() -> None:
    for area in AREAS:
        importlib.import_module(f"{__name__}.{area}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: entry.run for name, entry in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: entry.sql for name, entry in REGISTRY.items() if entry.sql}
