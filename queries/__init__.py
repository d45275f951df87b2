"""Registered queries with their SQL twins, one module per operator family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder, read on access."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def texts(self, *columns: str) -> DataFrame:
        """Documents for CPU-heavy text work, spread over the cores if the table is small."""
        return spread(self.documents.select(*columns) if columns else self.documents)


def query(sql: str | None = None):
    """Register a function of ``Tables`` under its name, with the SQL that must agree."""

    def add(fn: Callable[[Tables], DataFrame]):
        name = fn.__name__
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def load() -> None:
    from queries import arrays, batching, joins, logs, media, quality, stats, streams, texts  # noqa: F401
