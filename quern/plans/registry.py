"""Collects the queries of all plan modules, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.session import register

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def sql_query(name: str, tables: str, spark_sql: str, oracle: str | None = None) -> None:
    """A query in Spark SQL over `tables`; `oracle` is the reference SQL (None: the same text)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, tables.split())
        return spark.sql(spark_sql)

    frame_query(name, run, spark_sql if oracle is None else oracle)


def frame_query(name: str, run: Query, oracle: str | None = None) -> None:
    """A query built with the DataFrame API; oracle None: SQL cannot express it."""
    if name in _QUERIES:
        raise ValueError(f"two queries named {name}")
    _QUERIES[name] = run
    if oracle is not None:
        _ORACLE[name] = oracle


def _load() -> None:
    from quern.plans import aggregates, bitmap, extra, nested, relational, scalars, streaming, surface, tpch  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _ORACLE
