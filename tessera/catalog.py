"""Registered queries over the driver's tables, each with the SQL that gives the same rows.

A query is a thin application of the library's operators to whole tables. Columns derived for a query that the tables
lack (such as a response or a second translation) are made by the same rule in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) under its name."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _all() -> None:
    from tessera.plans import queries_chat, queries_rows, queries_stats, queries_text  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(ORACLE)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["conv_first_pair"](spark, sf_dir)
