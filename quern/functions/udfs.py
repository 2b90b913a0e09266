"""User-defined functions: scalar, aggregate, table and map, all Arrow-batched."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


#: Bytes of an Arrow batch of long texts: a worker holds several copies of one.
BATCH_BYTES = 8 << 20


def byte_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, as texts may be long, unless they are bounded tighter."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int("".join(c for c in str(spark.conf.get(key, "67108864b")) if c.isdigit()) or 0)
    if now == 0 or now > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def scalar(f: Callable, returns: T.DataType, null_aware: bool = False) -> Callable[..., Column]:
    """A vectorised scalar function of Python values; unless null_aware, a null argument gives null unasked."""

    @F.pandas_udf(returns)
    def run(*columns: pd.Series) -> pd.Series:
        rows = zip(*columns)
        return pd.Series([None if not null_aware and any(v is None or v != v for v in r) else f(*r) for r in rows], dtype="object")

    return run


@F.pandas_udf(T.DoubleType())
def trimmed_mean(x: pd.Series) -> float:
    """An aggregate UDF: the mean without the lowest and highest tenth."""
    s = x.dropna().sort_values()
    k = len(s) // 10
    return float(s.iloc[k : len(s) - k].mean()) if len(s) else float("nan")


def map_rows(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A function over pandas batches of a relation."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield f(batch)

    return df.mapInPandas(run, schema)


@F.udtf(returnType="n: int, square: int")
class Squares:
    """A table function: the squares of 1..n."""

    def eval(self, n: int):
        for i in range(1, n + 1):
            yield i, i * i
