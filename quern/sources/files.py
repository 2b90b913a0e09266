"""Readers and writers with the reference's options, on Spark's data sources."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str | None = None, delim: str = ",", header: bool = True, quote: str = '"', escape: str = '"', nullstr: str = "", rejects: bool = False, thousands: str | None = None, numeric: Sequence[str] = (), **options: str) -> DataFrame:
    """CSV; with rejects the malformed line is in `_reject`; thousands separators are taken out of the `numeric` columns."""
    reader = spark.read.options(sep=delim, header=header, quote=quote, escape=escape, nullValue=nullstr, mode="PERMISSIVE", **options)
    if schema:
        reader = reader.schema(schema + (", _reject string" if rejects else "")).option("columnNameOfCorruptRecord", "_reject")
    else:
        reader = reader.option("inferSchema", True)
    df = reader.csv(path if isinstance(path, str) else list(path))
    for c in numeric if thousands else ():
        df = df.withColumn(c, F.replace(F.col(c).cast("string"), F.lit(thousands), F.lit("")).cast("double"))
    return df


def sniff_csv(spark: SparkSession, path: str, candidates: str = ",;|\t", lines: int = 100) -> dict:
    """Delimiter, header and column types, from the first lines of a file: the delimiter that cuts them most evenly."""
    head = [re.sub(r'"[^"]*"', "", r[0]) for r in spark.read.text(path).limit(lines).collect()]
    best = max(candidates, key=lambda d: ((n := [x.count(d) for x in head if x]) and min(n) == max(n), min(n, default=0)))
    first = spark.read.options(sep=best, header=True, inferSchema=True).csv(path)
    plain = spark.read.options(sep=best, header=False, inferSchema=True).csv(path)
    has_header = all(t == "string" for _, t in plain.dtypes) and any(t != "string" for _, t in first.dtypes) or first.dtypes != plain.dtypes and len({c for c in first.columns}) == len(first.columns)
    return {"delimiter": best, "header": has_header, "columns": first.dtypes if has_header else plain.dtypes}


def write_csv(df: DataFrame, path: str, delim: str = ",", header: bool = True, force_quote: bool = False, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(sep=delim, header=header, quoteAll=force_quote, escape='"').csv(path)


def read_parquet(spark: SparkSession, path: str | Sequence[str], union_by_name: bool = False, filename: bool = False, file_row_number: bool = False) -> DataFrame:
    """Parquet; Hive partitions are found by themselves."""
    df = spark.read.option("mergeSchema", union_by_name).parquet(*([path] if isinstance(path, str) else path))
    extra = {}
    if filename:
        extra["filename"] = F.col("_metadata.file_path")
    if file_row_number:
        extra["file_row_number"] = F.col("_metadata.row_index")
    return df.withColumns(extra) if extra else df


def write_parquet(df: DataFrame, path: str, codec: str = "zstd", partition_by: Sequence[str] = (), max_rows: int | None = None, bloom: Sequence[str] = (), sort_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Parquet; sort_by clusters rows inside files, so that row-group statistics and Bloom filters skip more."""
    out = df.sortWithinPartitions(*sort_by) if sort_by else df
    writer = out.write.mode(mode).option("compression", codec)
    for c in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", True)
    if max_rows:
        writer = writer.option("maxRecordsPerFile", max_rows)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def parquet_schema(path: str) -> list[tuple[str, str]]:
    """Column names and physical types of one local Parquet file."""
    import pyarrow.parquet as pq

    schema = pq.ParquetFile(path).schema
    return [(schema.column(i).path, schema.column(i).physical_type) for i in range(len(schema))]


def parquet_metadata(path: str) -> list[dict]:
    """Row groups and column chunks of one local Parquet file."""
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(path).metadata
    return [
        {"row_group": g, "column": (c := meta.row_group(g).column(i)).path_in_schema, "num_values": c.num_values, "compressed": c.total_compressed_size, "codec": c.compression}
        for g in range(meta.num_row_groups) for i in range(meta.num_columns)
    ]


def read_json(spark: SparkSession, path: str, schema: str | None = None, lines: bool = True) -> DataFrame:
    """JSON lines, or whole files with an array or object each."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, timestamps to the microsecond."""
    df.write.mode(mode).options(timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)


def read_json_objects(spark: SparkSession, path: str) -> DataFrame:
    """Each line's JSON as text."""
    return spark.read.text(path).select(F.col("value").alias("json"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """filename, content, size of whole files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("filename"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))


def read_blob(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("filename"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))


def glob(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, by the file system of the pattern."""
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    return sorted(str(f.getPath()) for f in found)


def export_database(frames: dict[str, DataFrame], path: str) -> None:
    """Every table as Parquet under one folder."""
    for name, df in frames.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}.parquet")


def import_database(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    out = {n: spark.read.parquet(f"{path}/{n}.parquet") for n in names}
    for n, df in out.items():
        df.createOrReplaceTempView(n)
    return out
