"""What the plan modules share: table access and the registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a query under its function's name, with SQL for the same rows."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def joined(c: str) -> Column:
    """An array column as comma-joined text, which any engine's rows show alike."""
    return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
