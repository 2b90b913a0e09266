"""Best-fit packing of token pieces into sequences, bulk-synchronously.

Documents become token ids with an end id, cut into pieces of at most
`capacity`. Pieces are placed by decreasing length, each in the smallest gap
that holds it. Pieces of one length, and sequences with one gap, are
interchangeable; so the range-sorted lists of documents and gaps are kept as
runs: (length, count) and (gap, first sequence, count). A sweep takes the
longest unplaced length, finds its successor among the gaps, matches pieces to
sequences by rank, updates the gaps, and repeats. There are at most `capacity`
lengths and gaps whatever the input, so the sweeps cost nothing; the pieces
themselves never leave the executors. They get their rank within their length
(by salted counts, as one length may hold most of the rows) and look their
place up in the table of matches.

Defined results: null text counts as empty and has the end id alone. Rows that
repeat a doc_id are packed each on its own. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quern.llm.bpe import Encoder, Merges, Remembered
from quern.llm.common import materialize, resident, small_batches

CAPACITY, END_ID = 1024, 2
#: Rows of the table of matches up to which it is broadcast.
BROADCAST_ROWS = 200_000


class Ids:
    """Token ids of whole texts as little-endian bytes; common words are remembered. Merges are our own for texts that `Encoder.shared` splits, the library's for others."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        merges = Merges(path)
        self.encoder = Encoder(merges)
        self.model = Tokenizer.from_file(path).model
        self.table = {b: c for b, c in enumerate(self.encoder.characters)}
        self.known = Remembered(self._find)
        self.packed = [i.to_bytes(4, "little") for i in range(max(merges.tokens) + 1)]

    def _find(self, word: str | int) -> bytes:
        if isinstance(word, int):
            return self.packed[word]
        spelled = word.encode().decode("latin-1").translate(self.table)
        return b"".join([self.packed[t.id] for t in self.model.tokenize(spelled)])

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.encoder.words(text)))

    def many(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text; the words of some at a time are merged together."""
        at = 0
        for ids, where, count, places in self.encoder.shared(texts):
            for text, place in zip(texts[at : at + len(places)], places):
                if place is None:
                    yield self(text)
                    continue
                n = count[place]
                before = np.cumsum(n)
                yield ids[np.repeat(where[place] + n - before, n) + np.arange(before[-1] if len(n) else 0)].astype("<u4").tobytes()
            at += len(places)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, the first may be shorter."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *[(at, capacity) for at in range(first, n, capacity)]]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces. `path` must be readable on the executors."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = resident(("ids", path), lambda: Ids(path)).many
        for batch in batches:
            rows, out = [], []
            for at, found in enumerate(encode([text or "" for text in batch.column(1).to_pylist()])):
                ids = found + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append(at)
                    out.append((k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            values = np.array(out, np.int64).reshape(-1, 4)
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(values[:, 0].astype(np.int32)), *[pa.array(values[:, i]) for i in (1, 2, 3)]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    schema = docs.select("doc_id").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def sweeps(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Matches (length, first rank, number, first sequence, pieces a sequence, offset) of best-fit by decreasing length.

    Of a match, rank r goes to sequence first + (r - first rank) // pieces a
    sequence, its place is offset + (r - first rank) % pieces a sequence * length.
    """
    matches: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[int] = []
    runs: dict[int, list[tuple[int, int]]] = {}
    opened = 0

    def put(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in runs:
                runs[gap] = []
                insort(gaps, gap)
            runs[gap].append((first, count))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                count = -(-left // (capacity // length))
                put(capacity, opened, count)
                opened += count
                continue
            gap = gaps[at]
            first, count = runs[gap].pop()
            if not runs[gap]:
                del runs[gap]
                gaps.pop(at)
            each = gap // length
            number = min(left, count * each)
            matches.append((length, rank, number, first, each, capacity - gap))
            full, rest = divmod(number, each)
            put(gap - each * length, first, full)
            put(gap - rest * length, first + full, min(1, rest))
            used = full + min(1, rest)
            put(gap, first + used, count - used)
            rank, left = rank + number, left - number
    return matches


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces with column length (1 to capacity)."""
    spark = found.sparkSession
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    matches = sweeps(counts, capacity)
    schema = "length long, first_rank long, number long, first_sequence long, each long, at long"
    table = spark.createDataFrame(matches, schema)
    if len(matches) <= BROADCAST_ROWS:
        table = F.broadcast(table)
    salts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = salted.withColumn("inner", F.row_number().over(inside)).join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("inner") - 1)
    past = F.col("rank") - F.col("first_rank")
    placed = ranked.join(table, "length").filter((past >= 0) & (past < F.col("number")))
    return placed.select(
        *found.columns,
        (F.col("first_sequence") + F.floor(past / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + past % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )


def best_fit(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    found, _ = materialize(pieces(docs, path, capacity, end_id), "pieces")
    return pack(found, capacity)
