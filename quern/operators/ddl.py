"""Catalog objects: schemas, tables, views, their changes, and plans as text, through the session's catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quern.operators.shared import shared_dir


def create_schema(spark: SparkSession, name: str | None = None) -> str:
    """CREATE SCHEMA in the shared folder; the name, a fresh one by default."""
    name = name or f"quern_{uuid.uuid4().hex}"
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name} LOCATION '{shared_dir(spark).rstrip('/')}/{name}'")
    return name


def create_table(df: DataFrame, name: str, replace: bool = False) -> str:
    """CREATE [OR REPLACE] TABLE name AS: the rows of df as Parquet."""
    if replace:
        drop(df.sparkSession, "TABLE", name)
    df.write.format("parquet").saveAsTable(name)
    return name


def add_column(spark: SparkSession, table: str, name: str, kind: str) -> None:
    """ALTER TABLE ADD COLUMN; rows before it hold null."""
    spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({name} {kind})")


def rename_table(spark: SparkSession, table: str, name: str) -> None:
    spark.sql(f"ALTER TABLE {table} RENAME TO {name}")


def rewrite(spark: SparkSession, table: str, drop_columns: tuple[str, ...] = (), rename: dict[str, str] | None = None, cast: dict[str, str] | None = None) -> str:
    """ALTER TABLE DROP, RENAME or TYPE of columns, which Parquet tables lack: the table is written anew beside itself and takes its name."""
    df = spark.table(table).drop(*drop_columns)
    for name, kind in (cast or {}).items():
        df = df.withColumn(name, df[name].cast(kind))
    fresh = create_table(df.withColumnsRenamed(rename or {}), f"{table}_{uuid.uuid4().hex}")
    drop(spark, "TABLE", table)
    rename_table(spark, fresh, table)
    return table


def create_view(df: DataFrame, name: str) -> str:
    """CREATE OR REPLACE TEMP VIEW."""
    df.createOrReplaceTempView(name)
    return name


def drop(spark: SparkSession, kind: str, name: str) -> None:
    """DROP TABLE, VIEW or SCHEMA (with all it holds), if it is there."""
    spark.sql(f"DROP {kind} IF EXISTS {name}{' CASCADE' if kind == 'SCHEMA' else ''}")


def explain(spark: SparkSession, sql: str, how: str = "FORMATTED") -> str:
    """EXPLAIN how sql, as text; ANALYZE runs the query and tells the plan that adaptive execution came to."""
    if how == "ANALYZE":
        df = spark.sql(sql)
        df.write.format("noop").mode("overwrite").save()
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString()
    return spark.sql(f"EXPLAIN {how} {sql}").first()[0]


def reset(spark: SparkSession, key: str) -> None:
    """RESET key: the setting's default again."""
    spark.sql(f"RESET {key}")
