"""Registry and access to the input tables and derived views."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import tune
from .views import TABLES, with_clause


@dataclass
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}
_registered: dict[str, str] = {}


class Inputs:
    """Tables and derived views of one scale-factor folder, as DataFrames by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        clause, tables = with_clause(name)
        for table in tables:
            self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet").createOrReplaceTempView(table)
        return self.spark.sql(f"{clause} SELECT * FROM {name}")


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query. ``sql`` may use the derived ``views``; their WITH clause is put in front."""

    def wrap(fn: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Inputs(tune(spark), sf_dir))

        text = None
        if sql is not None:
            clause = with_clause(*views)[0] if views else ""
            body = sql.strip()
            if clause and body.upper().startswith("WITH RECURSIVE"):
                text = clause.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + body[len("WITH RECURSIVE") :]
            elif clause and body.upper().startswith("WITH"):
                text = clause + ", " + body[len("WITH") :]
            else:
                text = f"{clause} {body}"
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Entry(run, text)
        return fn

    return wrap


def half_even(num: str, den: str, digits: int) -> str:
    """SQL twin of the exact ratio: whole numbers, ties to even, NULL for a zero denominator."""
    scale = 10**digits
    n, d = f"(CAST({num} AS HUGEINT) * {scale})", f"CAST({den} AS HUGEINT)"
    q = f"({n} // {d})"
    up = f"(CASE WHEN 2 * ({n} - {q} * {d}) > {d} OR (2 * ({n} - {q} * {d}) = {d} AND {q} % 2 <> 0) THEN 1 ELSE 0 END)"
    return f"(CASE WHEN {d} = 0 THEN NULL ELSE CAST({q} + {up} AS DOUBLE) / {float(scale)} END)"
