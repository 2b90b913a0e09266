"""Removal of repeated byte strings by external induced suffix sorting.

A byte goes if a string of `LENGTH` bytes that covers it also starts anywhere
else. The suffixes of all texts cannot be sorted in one place, and most start
no repeated string, so the work is split without losing any match:

1. Texts. Of equal texts one takes part; from LENGTH bytes on all of them are
   repeated from end to end, whatever the others hold. So a text copied to any
   number of documents costs one text.
2. Anchors. Each window of LENGTH bytes chooses the least hash among its
   K-byte strings, the leftmost of equals. The choice depends on the window's
   bytes alone, so equal windows choose equal strings at equal offsets.
   Consecutive windows with one anchor form a fragment. An anchor hash that
   occurs once starts no repeated window; such fragments are dropped.
3. Equal fragments (anchor and content, 64 bits of hash each) are counted before
   anything moves: all windows of a fragment that occurs twice are repeated, and
   one of its copies stands for them where others share the anchor.
4. Shards. The fragments left go to the shard of their anchor. Spark's external
   sorter, a priority queue over runs on disk, hands a shard's fragments on in
   the order of their anchors, so a shard may be far larger than memory.
5. Induction. In a batch of whole groups, the suffixes that start at one
   distance from their anchors are kept sorted, with the common prefix of
   neighbours. The order at distance j follows from the order at distance j - 1
   by one stable pass over the bytes in front, and so do the common prefixes
   (one more byte, plus the least value in between). It begins at the far right
   end, 8 bytes a step. At each distance, neighbours with LENGTH common bytes
   are repeated windows.
6. Anchors that thousands of different fragments share would fill one task. Their fragments
   are split down to single windows, which are counted by anchor and window
   hash (64 bits each): partial counts, then verdicts by a join whose hot keys
   adaptive execution splits.

Defined results: null counts as empty; texts under LENGTH bytes lose nothing.
Rows that repeat a doc_id and text are documents of their own, so their texts
repeat. Rows with the same doc_id and different texts are told apart. Texts are
taken as equal by 128 bits of hash. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quern.llm.common import resident, small_batches

LENGTH, K = 200, 56
#: Fragments in one induction batch; an anchor is counted window by window from HOT fragments on, if one in eight of their
#: kinds fill KINDS of 64 places of a bitmap (some 2000 kinds do).
BATCH, HOT, KINDS = 16_384, 1_000, 63
#: Bytes hashed at once.
SLAB = 1 << 18
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEPS = np.random.default_rng(21).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each position, composed by doubling."""
    powers, width, level = {}, 1, _BYTES[x]
    while True:
        if k & width:
            powers[width] = level
        if width * 2 > k:
            break
        level = level[:-width] * _STEPS[width.bit_length()] + level[width:]
        width *= 2
    out, at, n = None, 0, len(x) - k + 1
    for width in sorted(powers, reverse=True):
        part = powers[width][at : at + n]
        out = part.copy() if out is None else out * _STEPS[32 + width.bit_length()] + part
        at += width
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    return out


def _spread(g: np.ndarray, start: np.ndarray, end: np.ndarray, most: int, k: int) -> np.ndarray:
    """A hash of the bytes start..end of each row (k at least, `most` at most), from the hashes g of the k-byte strings that cover them."""
    out = (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(-(-most // k)):
        out ^= out >> np.uint64(32)
        out = out * np.uint64(0x9E3779B97F4A7C15) + g[np.minimum(start + i * k, end - k)]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xD6E8FEB86659FD93)


def anchors(x: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """(position, first j, last j, hash, content) of the anchors of x: windows that start j before the position, for j in first..last; content is a hash of all their bytes."""
    n = len(x) - length + 1
    if n <= 0:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, np.empty(0, np.uint64), np.empty(0, np.uint64)
    w = length - k + 1
    g = gram_hashes(x, k)
    low = np.uint64((1 << 20) - 1)
    level = (g & ~low) | np.arange(len(g), dtype=np.uint64)
    width = 1
    while width * 2 <= w:
        level = np.minimum(level[:-width], level[width:])
        width *= 2
    least = np.minimum(level[:n], level[w - width : w - width + n])
    at = (least & low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:] - 1, n - 1]
    p = at[first]
    content = _spread(g, first, last + length, 2 * length - k, k) + (p - last).astype(np.uint64)
    return p, p - last, p - first, g[p], content


def windows(raw: bytes, length: int = LENGTH, k: int = K) -> np.ndarray:
    """A hash of each window of raw, which has `length` bytes at least."""
    x = np.frombuffer(raw, np.uint8)
    start = np.arange(len(x) - length + 1)
    return _spread(gram_hashes(x, k), start, start + length, length, k)


def text_anchors(raw: bytes, length: int = LENGTH, k: int = K) -> Iterator[tuple[np.ndarray, ...]]:
    """The anchors of a text of any size, slab by slab; a fragment that a slab's end cuts is two."""
    x = np.frombuffer(raw, np.uint8)
    for at in range(0, max(1, len(x) - length + 1), SLAB):
        p, *rest = anchors(x[at : at + SLAB + length - 1], length, k)
        yield p + at, *rest


def runs(raw: bytes, at: np.ndarray, first: np.ndarray, last: np.ndarray, h: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(which anchors stand for themselves and those left out, the extent that each covers beyond itself).

    In periodic text, anchors with equal hash and offsets follow at one
    distance. Of three or more with equal fragments, two are enough to know
    their windows as repeated, here and elsewhere; the second stands for the
    rest, whose last anchor is `extent` after it.
    """
    stay, extent = np.ones(len(at), bool), np.zeros(len(at), np.int64)
    like = (h[1:] == h[:-1]) & (first[1:] == first[:-1]) & (last[1:] == last[:-1])
    step = np.diff(at)
    for i in np.flatnonzero(like[1:] & like[:-1] & (step[1:] == step[:-1])).tolist():
        if not stay[i] or extent[i + 1] or (i and extent[i]):
            continue
        end, d = i + 2, int(step[i])
        while end + 1 < len(at) and like[end] and step[end] == d:
            end += 1
        a, b = int(at[i] - last[i]), int(at[end] - first[i]) + length
        if raw[a : b - d] == raw[a + d : b]:
            stay[i + 2 : end + 1] = False
            extent[i + 1] = at[end] - at[i + 1]
    return stay, extent


def induce(order: np.ndarray, lcp: np.ndarray, group: np.ndarray, symbol: np.ndarray, width: int, present: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Prepend a symbol of `width` bytes to every suffix: the new order and common prefixes.

    order: suffixes sorted within their groups (groups in ascending order);
    lcp[i]: common bytes of order[i - 1] and order[i], 0 at a group's start.
    symbol, group and, where symbols can be cut short, present (real bytes of
    the symbol) are by suffix.
    """
    s, g = symbol[order], group[order]
    cut = present is not None and (present < width).any()
    moved = np.flatnonzero((g[1:] == g[:-1]) & (s[1:] != s[:-1])).size or cut
    n = len(order)
    if moved:
        keys = (present[order], s, g) if cut else (s, g)
        perm = np.lexsort(keys)
        s, g = s[perm], g[perm]
        new = order[perm]
    else:
        perm, new = np.arange(n), order
    between = np.zeros(n, lcp.dtype)
    if n > 1:
        a, b = perm[:-1], perm[1:]
        near = b == a + 1
        between[1:][near] = lcp[b[near]]
        far = np.flatnonzero((b > a + 1) & (g[1:] == g[:-1]) & (s[1:] == s[:-1]))
        if len(far):
            padded = np.append(lcp, lcp.dtype.type(0))
            pairs = np.column_stack((a[far] + 1, b[far] + 1)).ravel()
            between[1:][far] = np.minimum.reduceat(padded, pairs)[::2]
    out = np.zeros(n, lcp.dtype)
    same = np.r_[False, g[1:] == g[:-1]]
    equal = same & np.r_[False, s[1:] == s[:-1]]
    if present is not None:
        real = present[new]
        full = np.r_[False, np.minimum(real[1:], real[:-1]) == width]
        differ = np.flatnonzero(same & ~(equal & full))
        if len(differ):
            x = s[differ] ^ s[differ - 1]
            common = np.full(len(differ), width, lcp.dtype)
            for i in range(width):
                common[(x >> np.uint64(8 * (width - 1 - i))) != 0] = np.minimum(common[(x >> np.uint64(8 * (width - 1 - i))) != 0], i)
            out[differ] = np.minimum(common, np.minimum(real[differ], real[differ - 1]))
        equal &= full
    out[equal] = between[equal] + width
    return new, out


def repeated_windows(group: np.ndarray, first: np.ndarray, last: np.ndarray, data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Boolean matrix: which windows (by fragment and j) have an equal one in another fragment of their group.

    A fragment's bytes, data[offsets[i]:offsets[i + 1]], begin `last` before
    its anchor and end with the last byte of its window at `first`.
    """
    n = len(group)
    _, gid = np.unique(group, return_inverse=True)
    anchor = offsets[:-1] + last
    real = length - first
    steps = -(-length // 8)
    order = np.argsort(gid, kind="stable")
    lcp = np.zeros(n, np.int32)
    limit = len(data) - 1
    for t in range(steps - 1, -1, -1):
        present = np.clip(real - 8 * t, 0, 8)
        if not present.any():
            continue
        symbol = np.zeros(n, np.uint64)
        for i in range(8):
            byte = data[np.minimum(anchor + 8 * t + i, limit)]
            symbol = (symbol << np.uint64(8)) | np.where(present > i, byte, 0).astype(np.uint64)
        order, lcp = induce(order, lcp, gid, symbol, 8, present)
    most = int(last.max())
    found = np.zeros((n, most + 1), bool)
    for j in range(most + 1):
        if j:
            stay = last[order] >= j
            if not stay.all():
                order, lcp = _without(order, lcp, stay, gid)
            order, lcp = induce(order, lcp, gid, _front(data, anchor, last, j), 1)
        long = lcp >= length
        hit = long.copy()
        hit[:-1] |= long[1:]
        found[order[hit], j] = True
    j = np.arange(most + 1)
    return found & (j >= first[:, None]) & (j <= last[:, None])


def _front(data: np.ndarray, anchor: np.ndarray, last: np.ndarray, j: int) -> np.ndarray:
    """The byte j before each anchor; 0 where the fragment has none."""
    return np.where(last >= j, data[np.maximum(anchor - j, 0)], 0)


def _without(order: np.ndarray, lcp: np.ndarray, stay: np.ndarray, gid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Drop suffixes from an order: a common prefix becomes the least of those up to it."""
    kept = np.flatnonzero(stay)
    if not len(kept):
        return order[:0], lcp[:0]
    starts = np.r_[0, kept[:-1] + 1]
    least = np.minimum.reduceat(lcp[: kept[-1] + 1], starts)
    new = order[kept]
    g = gid[new]
    least[np.r_[True, g[1:] != g[:-1]]] = 0
    return new, least


def sort_batch(group: np.ndarray, first: np.ndarray, last: np.ndarray, data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fragment, first j, last j) of the runs of repeated windows in whole groups of fragments."""
    found = repeated_windows(group, first, last, data, offsets, length)
    edges = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, starts = np.nonzero(edges == 1)
    _, ends = np.nonzero(edges == -1)
    return rows, starts, ends - 1


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, least: int) -> Iterator[pa.Table]:
    """Tables of `least` rows or more (but for the last) from batches in the order of `key`, cut between its values."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < least:
            continue
        table = pa.Table.from_batches(held)
        values = table.column(key).to_numpy()
        cut = int(np.flatnonzero(values != values[-1])[-1]) + 1 if values[0] != values[-1] else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _key(text: Column | str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), text)


def _other(key: str) -> Column:
    """The key under another value, one to one: the planner takes it for another key."""
    return F.col(key).bitwiseXOR(F.lit(0x5555555555555555))


def _types(names: str) -> str:
    return ", ".join(f"{n} long NOT NULL" for n in names.split())


def _span(c: Column, length: int) -> Column:
    """The bytes that all windows of a fragment cover, those of the run that it stands for included."""
    p, first, last = F.shiftright(c["packed"], 16), F.shiftright(c["packed"], 8).bitwiseAND(F.lit(255)), c["packed"].bitwiseAND(F.lit(255))
    return F.struct((p - last).alias("start"), (p + c["extent"] - first + length).alias("end"))


def _anchor_rows(length: int, k: int) -> Callable:
    names = ["_k1", "_k2", "h", "f", "packed", "extent"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("suffixes", dict)
        for batch in batches:
            keys = [np.asarray(batch.column(i)) for i in (0, 1)]
            held, rows = [], 0
            for at, text in enumerate(batch.column(2)):
                raw = text.as_py().encode()
                for p, first, last, h, f in text_anchors(raw, length, k):
                    if len(p):
                        stay, extent = runs(raw, p, first, last, h, length)
                        packed = (p << 16 | first << 8 | last)[stay]
                        held.append((np.full(len(packed), at), h[stay].view(np.int64), f[stay].view(np.int64), packed, extent[stay]))
                        rows += len(packed)
                if held and (rows > 1 << 17 or at + 1 == batch.num_rows):
                    at_row, *columns = (np.concatenate(x) for x in zip(*held))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[0][at_row]), pa.array(keys[1][at_row]), *map(pa.array, columns)], names)
                    held, rows = [], 0

    return run


def _chosen(batch: pa.RecordBatch, length: int, flag: str) -> Iterator[tuple]:
    """For each text of the batch: its row, its bytes, and of its fragments with the flag anchor, position, extent, first, last, start and end."""
    for at, (text, chosen) in enumerate(zip(batch.column(2), batch.column(3))):
        packed, h, extent, flagged = (chosen.values.field(n).to_numpy(zero_copy_only=False) for n in ("packed", "h", "extent", flag))
        mine = np.flatnonzero(flagged)
        if len(mine):
            packed, h, extent = packed[mine], h[mine], extent[mine]
            p, first, last = packed >> 16, packed >> 8 & 255, packed & 255
            yield at, text.as_py().encode(), h, p, extent, first, last, p - last, p - first + length


def _fragment_rows(length: int) -> Callable:
    names = ["_k1", "_k2", "shard", "p", "extent", "first", "last", "raw"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("suffixes", dict)
        for batch in batches:
            keys = [np.asarray(batch.column(i)) for i in (0, 1)]
            held, pieces, size = [], [], 0

            def full() -> pa.RecordBatch:
                at_row, h, p, extent, first, last = (np.concatenate(x) for x in zip(*held))
                return pa.RecordBatch.from_arrays([pa.array(c) for c in (keys[0][at_row], keys[1][at_row], h, p, extent, first.astype(np.int16), last.astype(np.int16))] + [pa.array(pieces, pa.binary())], names)

            for at, raw, h, p, extent, first, last, start, end in _chosen(batch, length, "sort"):
                held.append((np.full(len(p), at), h, p, extent, first, last))
                pieces += [raw[a:b] for a, b in zip(start.tolist(), end.tolist())]
                size += int((end - start).sum())
                if size > 1 << 23:
                    yield full()
                    held, pieces, size = [], [], 0
            if held:
                yield full()

    return run


def _window_rows(length: int, k: int) -> Callable:
    names = ["_k1", "_k2", "h", "w", "start", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("suffixes", dict)
        for batch in batches:
            keys = [np.asarray(batch.column(i)) for i in (0, 1)]
            for at, raw, h, p, extent, first, last, start, end in _chosen(batch, length, "count"):
                found = [windows(raw[a:b], length, k) for a, b in zip(start.tolist(), end.tolist())]
                count = last - first + 1
                begin = np.concatenate([np.arange(a, a + n) for a, n in zip(start.tolist(), count.tolist())])
                for i in range(0, len(begin), 1 << 16):
                    some = slice(i, i + (1 << 16))
                    n = len(begin[some])
                    columns = (np.full(n, keys[0][at]), np.full(n, keys[1][at]), np.repeat(h, count)[some], np.concatenate(found).view(np.int64)[some], begin[some], begin[some] + np.repeat(extent, count)[some] + length)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return run


def _shard_rows(length: int, batch_size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("suffixes", dict)
        for table in whole_groups(batches, "shard", batch_size):
            k1, k2, shard, p, extent, first, last = (table.column(i).to_numpy().astype(np.int64, copy=False) for i in range(7))
            data = np.frombuffer(b"".join(table.column(7).to_pylist()), np.uint8)
            offsets = np.r_[0, np.cumsum(length + last - first)]
            row, a, b = sort_batch(shard, first, last, data, offsets, length)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (k1[row], k2[row], p[row] - b, p[row] + extent[row] - a + length)], ["_k1", "_k2", "start", "end"])

    return run


def _kept(raw: bytes, *lists: pa.Scalar) -> tuple[bytes, int]:
    """What stays of raw without the spans of the lists, and the number of maximal removed runs."""
    merged: list[list[int]] = []
    known = [x.values for x in lists if x.is_valid and len(x)]
    if known:
        starts, ends = (np.concatenate([v.field(i).to_numpy(zero_copy_only=False) for v in known]) for i in range(2))
        for i in np.argsort(starts, kind="stable").tolist():
            if merged and starts[i] <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], int(ends[i]))
            else:
                merged.append([int(starts[i]), int(ends[i])])
    kept = [raw[a:b] for a, b in zip([0, *[m[1] for m in merged]], [*[m[0] for m in merged], len(raw)])]
    return b"".join(kept), len(merged)


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    resident("suffixes", dict)
    for batch in batches:
        out = []
        for text, *spans in zip(*batch.columns[1:]):
            raw = text.as_py().encode()
            kept, runs = _kept(raw, *spans)
            out.append((len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    resident("suffixes", dict)
    for batch in batches:
        texts = [_kept(text.as_py().encode(), *spans)[0].decode("utf-8", "ignore") for text, *spans in zip(*batch.columns[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])


def judged(docs: DataFrame, carry: Column, length: int = LENGTH, k: int = K, batch: int = BATCH, hot: int = HOT, kinds: int = KINDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of docs in three parts, each with `row` (what `carry` holds):

    row, text of those under `length` bytes; row, n_bytes of those whose text
    occurs more than once; row, text, _whole and _spans of the others, the
    (start, end) byte ranges that repeat, which may touch or overlap.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), carry.alias("row")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    short, long = rows.filter(F.col("n_bytes") < length).select("row", "text"), rows.filter(F.col("n_bytes") >= length)
    keyed = long.select(_key("text", 0).alias("_k1"), _key("text", 1).alias("_k2"), "text", "row", "n_bytes")
    again = keyed.groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_k1", "_k2")
    copied = keyed.select("_k1", "_k2", "row", "n_bytes").join(again, ["_k1", "_k2"], "left_semi").select("row", "n_bytes")
    # One exchange brings each text once to its key. Every use below reads it, so each must take all of its columns.
    texts = keyed.groupBy("_k1", "_k2").agg(F.first(F.struct("text", "row")).alias("_v"), F.count(F.lit(1)).alias("_copies")).select("_k1", "_k2", F.col("_v.text").alias("text"), "_v", "_copies")
    # The anchors are found twice, once to count them: that costs less than to keep them.
    found = texts.select("_k1", "_k2", "text", "_copies").mapInArrow(_anchor_rows(length, k), _types("_k1 _k2 h f packed extent"))
    kind = F.when(F.col("f").bitwiseAND(F.lit(7)) == 0, F.expr("shiftleft(1L, cast(shiftright(f, 3) & 63 AS int))")).otherwise(F.lit(0))
    counts = found.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("f").alias("lo"), F.max("f").alias("hi"), F.bit_or(kind).alias("kinds")).filter("n > 1")
    # One value, so that no use leaves out a count: 0, all fragments alike; 2, hot; 1, others.
    group = F.when(F.col("lo") == F.col("hi"), 0).when((F.col("n") > hot) & (F.bit_count("kinds") >= kinds), 2).otherwise(1)
    groups = counts.select(_other("h").alias("h"), group.alias("group"))
    # Keys of joins differ from those of the aggregates beside them, so that both sides are exchanged and a hot key can be split.
    met = found.withColumn("h", _other("h")).join(groups, "h").withColumn("g", F.col("h").bitwiseXOR(F.col("f")))
    own = F.xxhash64("_k1", "_k2", "packed", "extent")
    equal = met.filter("group > 0").groupBy("g", "f").agg(F.count(F.lit(1)).alias("equals"), F.min(own).alias("one"))
    told = met.withColumn("g", _other("g")).join(equal.withColumn("g", _other("g")), ["g", "f"], "left")
    whole = F.col("equals").isNull() | (F.col("equals") > 1)
    sort = F.coalesce((F.col("equals") == 1) | (own == F.col("one")), F.lit(False))
    about = F.struct("packed", F.col("g").bitwiseXOR(F.col("f")).alias("h"), "extent", (sort & (F.col("group") == 1)).alias("sort"), (sort & (F.col("group") == 2)).alias("count"), whole.alias("whole"))
    chosen = told.groupBy("_k1", "_k2").agg(F.collect_list(about).alias("_chosen"))
    cut = texts.join(chosen.hint("shuffle_hash"), ["_k1", "_k2"]).select("_k1", "_k2", "text", "_chosen", "_copies")
    fragments = cut.filter(F.exists("_chosen", lambda c: c["sort"])).mapInArrow(_fragment_rows(length), "_k1 long, _k2 long, shard long, p long, extent long, first short, last short, raw binary")
    sorted_ = fragments.repartition("shard").sortWithinPartitions("shard").mapInArrow(_shard_rows(length, batch), _types("_k1 _k2 start end"))
    single = cut.filter(F.exists("_chosen", lambda c: c["count"])).mapInArrow(_window_rows(length, k), _types("_k1 _k2 h w start end"))
    twice = single.groupBy("h", "w").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(_other("h").alias("h"), "w")
    by_window = single.withColumn("h", _other("h")).join(twice, ["h", "w"]).select("_k1", "_k2", "start", "end")
    by_text = sorted_.union(by_window).groupBy("_k1", "_k2").agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    all_told = texts.join(chosen.hint("shuffle_hash"), ["_k1", "_k2"], "left").join(by_text.hint("shuffle_hash"), ["_k1", "_k2"], "left")
    alone = all_told.filter("_copies = 1").select("_v.row", "text", F.transform(F.filter("_chosen", lambda c: c["whole"]), lambda c: _span(c, length)).alias("_whole"), "_spans")
    return short, copied, alone


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, batch: int = BATCH, hot: int = HOT, kinds: int = KINDS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    short, copied, alone = judged(docs, F.col("doc_id"), length, k, batch, hot, kinds)
    none = F.lit(0).cast("long")
    n = F.octet_length("text").cast("long")
    as_they_are = short.select(F.col("row").alias("doc_id"), n.alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    gone = copied.select(F.col("row").alias("doc_id"), "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"))
    rest = alone.mapInArrow(_digest_rows, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return as_they_are.union(gone).union(rest)


def without_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, batch: int = BATCH, hot: int = HOT, kinds: int = KINDS) -> DataFrame:
    """All columns of docs, text without its repeated bytes; a character that a cut splits goes whole."""
    carry = F.struct(*[c for c in docs.columns if c != "text"])
    short, copied, alone = judged(docs, carry, length, k, batch, hot, kinds)
    kind = alone.schema["row"].dataType.simpleString()
    rest = alone.mapInArrow(_text_rows, f"row {kind}, text string")
    kept = short.union(copied.select("row", F.lit("").alias("text"))).union(rest)
    return kept.select(*[F.col(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
