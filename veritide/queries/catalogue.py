"""Registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a function of (t, spark), t reading a table by name, under a name, with its SQL if there is any."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda n: table(spark, sf_dir, n), spark)

        if name in QUERIES:
            raise ValueError(f"two queries {name}")
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return f

    return add
