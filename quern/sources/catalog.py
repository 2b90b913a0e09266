"""Catalog listings and other session facts as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def tables(spark: SparkSession) -> DataFrame:
    """table_name, temporary, table_type of the current database and of temp views."""
    rows = [(t.name, t.isTemporary, t.tableType) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table_name string, temporary boolean, table_type string")


def columns(spark: SparkSession, table: str) -> DataFrame:
    """column_name, data_type, nullable, ordinal (from 1)."""
    rows = [(c.name, c.dataType, c.nullable, i) for i, c in enumerate(spark.catalog.listColumns(table), 1)]
    return spark.createDataFrame(rows, "column_name string, data_type string, nullable boolean, ordinal int")


def databases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d.name,) for d in spark.catalog.listDatabases()], "database_name string")


def functions(spark: SparkSession, pattern: str | None = None) -> DataFrame:
    return spark.createDataFrame([(f.name,) for f in spark.catalog.listFunctions(pattern=pattern)], "function_name string").distinct()


def settings(spark: SparkSession) -> DataFrame:
    return spark.sql("SET").select(F.col("key").alias("name"), "value")


def current_setting(spark: SparkSession, name: str) -> str | None:
    return spark.conf.get(name, None)


def repeat(df: DataFrame, n: int) -> DataFrame:
    """repeat(row, n): every row n times, without a join."""
    return df.select("*", F.explode(F.array_repeat(F.lit(1), n)).alias("__one")).drop("__one")


def histogram_table(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """bin_low, bin_high, n of a numeric column in bins of equal width; one pass for the range, one for the counts."""
    low, high = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin_low double, bin_high double, n long")
    width = (high - low) / bins or 1.0
    place = F.least(F.floor((F.col(column).cast("double") - low) / width), F.lit(bins - 1))
    counts = df.filter(F.col(column).isNotNull()).groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).join(counts, F.col("id") == F.col("b"), "left")
    return every.select((F.col("id") * width + low).alias("bin_low"), ((F.col("id") + 1) * width + low).alias("bin_high"), F.coalesce("n", F.lit(0)).alias("n"))


def query_table(spark: SparkSession, names: list[str], by_name: bool = False) -> DataFrame:
    """UNION ALL of tables by name."""
    out = spark.table(names[0])
    for name in names[1:]:
        other = spark.table(name)
        out = out.unionByName(other, allowMissingColumns=True) if by_name else out.union(other)
    return out
