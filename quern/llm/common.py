"""What several operators share: inputs, lineage cuts, whitespace words, packed bit counts."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The six ASCII whitespace bytes 0x20 and 0x09-0x0D.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole `documents` table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured and all run on one machine (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        configured = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors.

    Returns the new frame and its path, for `discard`. What is not discarded is
    removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quern-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove tables written by `materialize` that no plan needs any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes of an Arrow batch: several copies of one are in a Python worker at a time.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, as texts may be long, unless they are bounded tighter."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int("".join(c for c in str(spark.conf.get(key, "67108864b")) if c.isdigit()) or 0)
    if now == 0 or now > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


_RESIDENT: dict = {}


def resident(key, make):
    """An object that a Python worker keeps from task to task, one at a time: asking for another frees it."""
    if key not in _RESIDENT:
        if _RESIDENT:
            _RESIDENT.clear()
            give_back()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def give_back() -> None:
    """Return freed memory of this process to the system: allocators keep it otherwise, beside what the next operator needs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """Runs of anything but ASCII whitespace; [''] for a text without any."""
    return F.split(F.btrim(text, F.lit(ASCII_SPACE)), r"[\x20\x09-\x0D]+")


def lanes(h: Column) -> list[Column]:
    """The 64 bits of a hash as 32 longs of two 32-bit lanes each, so that 32 sums count all 64 bits.

    Lane sums are exact up to 2**31 hashes a group. Column i holds bits i and i + 32.
    """
    mask = F.lit(0x0000000100000001)
    return [F.shiftrightunsigned(h, i).bitwiseAND(mask) for i in range(32)]


def majority(counts: list[Column], total: Column) -> Column:
    """A long whose bit is 1 where the lane count is over half of `total` (see `lanes`)."""
    out = F.lit(0).cast("long")
    for i, c in enumerate(counts):
        low, high = c.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(c, 32)
        for count, bit in ((low, i), (high, i + 32)):
            value = 1 << bit
            out = out.bitwiseOR(F.when(count * 2 > total, F.lit(value - (1 << 64) if value >= 1 << 63 else value)).otherwise(F.lit(0).cast("long")))
    return out


def hex16(fingerprint: Column) -> Column:
    """16 lowercase hex digits of a long."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


#: Groups with over 1 in HOT_SHARE of the rows, and over HOT_ROWS rows, are joined apart; there are at most HOT_SHARE of them.
HOT_SHARE, HOT_ROWS = 1000, 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows with the columns of their group; groups has one row a key and in `size` its number of rows, of `total`.

    The few hot groups are broadcast, so their rows stay where they are; the
    others, each a small share, meet their rows in a shuffle.
    """
    limit = max(HOT_ROWS, total // HOT_SHARE)
    hot = F.broadcast(groups.filter(F.col(size) > limit))
    cold = rows.join(hot.select(key), key, "left_anti").join(groups.filter(F.col(size) <= limit), key)
    return rows.join(hot, key).unionByName(cold)
