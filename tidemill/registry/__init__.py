"""Named queries over the given tables, each with an independent SQL form where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.sources.files import load_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables; they hold no NaN."""
    return load_table(spark, f"{folder.rstrip('/')}/{name}.parquet", normalise=False)


def query(name: str, sql: str | None = None):
    """Register ``fn(t, spark)`` where ``t(table_name)`` loads a table."""

    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(lambda table_name: table(spark, folder, table_name), spark)

        run.__name__ = name
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load_all() -> None:
    from tidemill.registry import (  # noqa: F401
        aggregates,
        cleaning,
        combining,
        inspection,
        lossless,
        modelling,
        series,
        sources,
        sqlqueries,
    )
