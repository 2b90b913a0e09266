"""Row changes on immutable tables: each gives the table after the change, to be written as a new version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True).select(*table.columns)


def delete(table: DataFrame, condition: Column) -> DataFrame:
    """Rows where the condition is not true stay."""
    return table.filter(~F.coalesce(condition, F.lit(False)))


def delete_keys(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return table.join(keys.select(*on).distinct(), list(on), "left_anti")


def update(table: DataFrame, condition: Column, **values: Column) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    return table.withColumns({c: F.when(hit, v).otherwise(F.col(c)).cast(table.schema[c].dataType) for c, v in values.items()})


def upsert(table: DataFrame, rows: DataFrame, on: Sequence[str], conflict: str = "update") -> DataFrame:
    """INSERT ... ON CONFLICT (on) DO UPDATE or DO NOTHING; rows must be unique on the keys."""
    rows = rows.select(*table.columns)
    if conflict == "nothing":
        return table.unionByName(rows.join(table.select(*on), list(on), "left_anti"))
    return table.join(rows.select(*on), list(on), "left_anti").select(*table.columns).unionByName(rows)


def merge(table: DataFrame, rows: DataFrame, on: Sequence[str], matched: dict[str, Column] | None, insert_new: bool = True) -> DataFrame:
    """MERGE: matched rows take the given columns (rows' columns are s_<name>), others are inserted.

    Keys match by plain equality, so a null key matches nothing and its row is
    inserted. Two rows that match one row of the table raise an error.
    """
    source = rows.select(*[F.col(c).alias(f"s_{c}") for c in rows.columns], F.lit(True).alias("s__hit"), F.count(F.lit(1)).over(Window.partitionBy(*on)).alias("s__n"))
    joined = table.join(source, [F.col(c) == F.col(f"s_{c}") for c in on], "left")
    once = joined.filter(F.when(F.col("s__n") > 1, F.raise_error(F.lit("several rows match one row of the table"))).otherwise(F.lit(True)))
    changed = once.select(*[F.when(F.col("s__hit"), matched[c]).otherwise(F.col(c)).alias(c) if matched and c in matched else F.col(c) for c in table.columns])
    return changed.unionByName(rows.select(*table.columns).join(table.select(*on), list(on), "left_anti")) if insert_new else changed


def violations(table: DataFrame, checks: dict[str, Column], not_null: Sequence[str] = (), unique: Sequence[Sequence[str]] = ()) -> DataFrame:
    """constraint, n: how often each constraint is broken."""
    conditions = checks | {f"not_null_{c}": F.col(c).isNotNull() for c in not_null}
    spark = table.sparkSession
    out = spark.createDataFrame([], "constraint string, n long")
    if conditions:
        counted = table.agg(*[F.count_if(~c).alias(n) for n, c in conditions.items()])
        out = counted.select(F.explode(F.map_from_arrays(F.lit(list(conditions)), F.array(*[F.col(n) for n in conditions]))).alias("constraint", "n"))
    for keys in unique:
        repeated = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(repeated.select(F.lit("unique_" + "_".join(keys)).alias("constraint"), "n"))
    return out


def foreign_key_violations(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def create_function(spark: SparkSession, definition: str) -> None:
    """A scalar or table macro: `name(args) RETURNS type RETURN expression`."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {definition}")


def set_variable(spark: SparkSession, name: str, expression: str) -> None:
    spark.sql(f"DECLARE OR REPLACE VARIABLE {name} = {expression}")


def prepared(spark: SparkSession, sql: str, **arguments) -> DataFrame:
    """A statement with named parameters."""
    return spark.sql(sql, args=arguments)
