"""Event-time windows over streams; the same functions run on batch tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_stream(spark: SparkSession, folder: str, schema: str = EVENTS, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling(events: DataFrame, width: str, keys: list[str], lateness: str = "10 minutes", **aggregates: Column) -> DataFrame:
    """Aggregates by key and window of fixed width; events later than the watermark are left out of a stream."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width), *keys).agg(*[a.alias(n) for n, a in aggregates.items()])


def sliding(events: DataFrame, width: str, slide: str, keys: list[str], lateness: str = "10 minutes", **aggregates: Column) -> DataFrame:
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width, slide), *keys).agg(*[a.alias(n) for n, a in aggregates.items()])


def sessions(events: DataFrame, gap: str, keys: list[str], lateness: str = "10 minutes", **aggregates: Column) -> DataFrame:
    """Aggregates by key and session: events less than `gap` apart."""
    return events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), *keys).agg(*[a.alias(n) for n, a in aggregates.items()])


def first_seen(events: DataFrame, keys: list[str], lateness: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def running_totals(events: DataFrame) -> DataFrame:
    """user_id, n, total: per-user state that follows the stream (update mode)."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for batch in batches:
            n, total = n + len(batch), total + float(batch["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there, then stop; the result is the memory table `name`."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
