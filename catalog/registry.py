"""Registration of queries together with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalog.views import TABLES, cte, spark_view, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """Views and tables of one scale-factor folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name in TABLES:
            return table(self.spark, self.sf_dir, name)
        return spark_view(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None, parts: dict[str, str] | None = None,
          recursive: bool = False):
    """Register ``fn(inputs) -> DataFrame`` under ``name``, with an oracle if there is one."""
    def register(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = cte(sql, parts, recursive)
        return fn
    return register
