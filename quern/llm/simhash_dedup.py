"""SimHash near-dedup over vantage-point trees.

Fingerprint: A-Z lower-cased, words between ASCII whitespace, shingles of
`TERMS` words with repeats, XXH64 (seed 42), majority vote on each of 64 bits.

Pairs: two fingerprints with at most `radius` differing bits have at most one
in one of `radius // 2 + 1` blocks of their bits (two halves for radius 3).
For each block there is one vantage-point tree: a node keeps the values within
its threshold of its vantage on one side, the others on the other side. A
fingerprint has one home leaf and also visits every leaf that the triangle
bound cannot rule out for one differing bit; so the leaves are shards that
overlap at their boundaries, and each shard finds its exact pairs, with further
vantage points, alone.

The tree is fitted on a bounded sample (`SAMPLE_A_LEAF` values for each of at
most `MAX_LEAVES` leaves); it decides only where values go, never which pairs
count. A shard emits a spanning forest of its links, not its pairs.

Defined results: null and empty texts have fingerprint 0 and link like any
other. Repeated rows (same doc_id, same text) come out as often as they went
in. Rows with one doc_id but different texts are separate rows. A component
without any doc_id has component_id null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quern.llm.common import ascii_lower, discard, hex16, join_groups, lanes, majority, materialize, resident, small_batches, words
from quern.llm.crowds import crowd_links, similar
from quern.llm.graph import components

RADIUS, TERMS = 3, 3
#: Fingerprints in a shard that the tree aims at, and the bounds of what the driver holds to fit it.
LEAF, MAX_LEAVES, SAMPLE_A_LEAF = 8192, 1 << 16, 16
#: Pairs compared at once, and home values under which a shard stops splitting.
BLOCK, SMALL = 1 << 20, 512


def shingles(w, n: int = 3):
    """Array of structs of n words in a row, from a column of words; fewer words are one struct, none give an empty array."""
    size = F.size(w)
    names = [f"w{i}" for i in range(n)]
    long = F.arrays_zip(*[F.slice(w, i + 1, F.greatest(size - (n - 1), F.lit(0))).alias(names[i]) for i in range(n)])
    short = F.array(F.struct(F.array_join(w, " ").alias("w0"), *[F.lit(None).cast("string").alias(x) for x in names[1:]]))
    none = F.filter(short, lambda _: F.lit(False))
    return F.when(w[0] == "", none).when(size < n, short).otherwise(long)


def fingerprints(docs: DataFrame, terms: int = TERMS) -> DataFrame:
    """doc_id, th (a hash of the text) and `fp` (long) of every row's text."""
    split = docs.select("doc_id", F.xxhash64("text").alias("th"), words(ascii_lower(F.coalesce("text", F.lit("")))).alias("w"))
    rows = split.select("doc_id", "th", F.posexplode_outer(shingles(F.col("w"), terms)).alias("pos", "s"))
    hashed = rows.select("doc_id", "th", F.coalesce(F.col("pos"), F.lit(0)).alias("pos"), F.when(F.col("pos").isNotNull(), F.xxhash64(F.concat_ws(" ", *[f"s.w{i}" for i in range(terms)]))).alias("h"))
    counted = hashed.groupBy("doc_id", "th").agg(
        F.count("h").alias("n"),
        F.sum(F.when(F.col("pos") == 0, 1).otherwise(0)).alias("rows"),
        *[F.sum(x).alias(f"c{i}") for i, x in enumerate(lanes(F.col("h")))],
    )
    fp = F.when(F.col("n") == 0, F.lit(0).cast("long")).otherwise(majority([F.col(f"c{i}") for i in range(32)], F.col("n")))
    voted = counted.select("doc_id", "th", fp.alias("fp"), F.col("rows").cast("int").alias("rows"))
    return voted.select("doc_id", "th", "fp", F.explode(F.array_repeat(F.lit(1), F.col("rows"))).alias("one")).drop("one")


def bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Tree:
    """A vantage-point tree over unsigned values: arrays of vantage, threshold and children (leaves are -1 - number)."""

    def __init__(self, sample: np.ndarray, leaves: int, radius: int, seed: int = 7) -> None:
        self.vantage: list[int] = []
        self.threshold: list[int] = []
        self.children: list[list[int]] = []
        self.radius, self.leaves = radius, 0
        rng = np.random.default_rng(seed)
        self.root = self._split(np.unique(sample), max(1, leaves), rng)
        self.vantages, self.thresholds = np.array(self.vantage, sample.dtype), np.array(self.threshold, np.int16)
        self.below = np.array(self.children, np.int64).reshape(-1, 2)

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _split(self, values: np.ndarray, leaves: int, rng: np.random.Generator) -> int:
        if leaves <= 1 or len(values) < 8:
            return self._leaf()
        found = choose(values, rng, self.radius)
        if found is None:
            return self._leaf()
        vantage, threshold = found
        at = len(self.vantage)
        self.vantage.append(int(vantage))
        self.threshold.append(int(threshold))
        self.children.append([0, 0])
        near = bits(values, vantage) <= threshold
        left = max(1, min(leaves - 1, round(leaves * near.mean())))
        self.children[at] = [self._split(values[near], left, rng), self._split(values[~near], leaves - left, rng)]
        return at

    def route(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the value, leaf, whether it is the value's home) for every leaf within reach of every value."""
        index, leaf, home = [], [], []
        todo = [(self.root, np.arange(len(values)), np.ones(len(values), bool))]
        while todo:
            node, which, own = todo.pop()
            if not len(which):
                continue
            if node < 0:
                index.append(which)
                leaf.append(np.full(len(which), -1 - node, np.int32))
                home.append(own)
                continue
            d = bits(values[which], self.vantages[node]).astype(np.int16)
            t = self.thresholds[node]
            near, far = d - self.radius <= t, d + self.radius > t
            todo.append((int(self.below[node, 0]), which[near], own[near] & (d[near] <= t)))
            todo.append((int(self.below[node, 1]), which[far], own[far] & (d[far] > t)))
        if not index:
            return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, bool)
        return np.concatenate(index), np.concatenate(leaf), np.concatenate(home)


def choose(values: np.ndarray, rng: np.random.Generator, radius: int, tries: int = 6) -> tuple | None:
    """Of some vantage points and balanced thresholds, the pair with the fewest values near the boundary; None: no split."""
    best = None
    for vantage in values[rng.integers(0, len(values), tries)]:
        d = bits(values, vantage).astype(np.int64)
        below = np.cumsum(np.bincount(d, minlength=66)) / len(values)
        for t in range(65):
            if 0.25 <= below[t] <= 0.75:
                both = below[min(65, t + radius)] - (below[t - radius] if t >= radius else 0.0)
                if best is None or both < best[0]:
                    best = (both, vantage, t)
    return best and best[1:]


class Forest:
    """Union-find over positions, with whole arrays of links at once."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            if np.array_equal(up, x):
                return x
            self.parent[x] = self.parent[up]
            x = self.parent[x]

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def shard_links(home: np.ndarray, query: np.ndarray, part, part_radius: int, radius: int, link, rng=None) -> None:
    """Call link(home positions, query positions) for all pairs within `radius` whose blocks are within `part_radius`."""
    rng = rng or np.random.default_rng(11)
    todo = [(np.arange(len(home)), np.arange(len(query)))]
    while todo:
        h, q = todo.pop()
        if not len(h) or not len(q):
            continue
        found = choose(part(home[h]), rng, part_radius, 3) if len(h) > SMALL else None
        if found is None:
            step = max(1, BLOCK // len(h))
            for at in range(0, len(q), step):
                some = q[at : at + step]
                i, j = np.nonzero(bits(query[some][:, None], home[h][None, :]) <= radius)
                link(h[j], some[i])
            continue
        vantage, t = found
        dh, dq = bits(part(home[h]), vantage), bits(part(query[q]), vantage).astype(np.int16)
        todo.append((h[dh <= t], q[dq - part_radius <= t]))
        todo.append((h[dh > t], q[dq + part_radius > t]))


def blocks(radius: int) -> list:
    """Functions that take a block of bits out of 64-bit values: as many blocks as leave one of them at most one differing bit within radius."""
    n = max(2, radius // 2 + 1)

    def block(i: int):
        low, high = 64 * i // n, 64 * (i + 1) // n
        return lambda v: (v >> np.uint64(low) & np.uint64((1 << (high - low)) - 1)).astype(np.uint32)

    return [block(i) for i in range(n)]


#: Differing bits that the block of a pair's choice has at most.
BLOCK_RADIUS = 1


#: Pairs of a fingerprint within a shard up to which each is proposed by itself.
CROWDED = 32


def links(nodes: DataFrame, radius: int = RADIUS, leaf: int = LEAF, propose: bool = False) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) that connect all pairs within `radius`.

    `propose`: (u, v, crowd), some repeatedly. Each pair within `radius` is a
    row with crowd false, or both its fingerprints have over `CROWDED` pairs in
    a shard and rows with crowd true connect them. So the rows follow the
    number of fingerprints, however many of them are near one another.
    """
    count = nodes.count()
    leaves = min(MAX_LEAVES, max(1, count // leaf))
    wanted = SAMPLE_A_LEAF * leaves
    sample = nodes.select("fp").filter(F.pmod(F.xxhash64("fp", F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.2 * wanted / max(1, count)))).limit(2 * wanted)
    values = np.array([r[0] for r in sample.collect()], np.int64).view(np.uint64)
    parts = blocks(radius)
    trees = [Tree(part(values), leaves, BLOCK_RADIUS) for part in parts]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("fingerprints", dict)
        for batch in batches:
            fps = np.asarray(batch.column(0)).astype(np.int64, copy=False)
            for k, part in enumerate(parts):
                index, where, home = trees[k].route(part(fps.view(np.uint64)))
                for at in range(0, len(index), 1 << 18):
                    cut = slice(at, at + (1 << 18))
                    yield pa.RecordBatch.from_arrays([pa.array(where[cut] * len(parts) + k, pa.int32()), pa.array(fps[index[cut]]), pa.array(home[cut])], ["shard", "fp", "home"])

    def pairs(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        query = rows["fp"].to_numpy(np.int64).view(np.uint64)
        own = np.flatnonzero(rows["home"].to_numpy(bool))
        forest = Forest(len(query))
        shard_links(query[own], query, parts[key[0] % len(parts)], BLOCK_RADIUS, radius, lambda h, q: forest.link(own[h], q))
        root = forest.find(np.arange(len(query)))
        moved = np.flatnonzero(root != np.arange(len(query)))
        return pd.DataFrame({"u": query[moved].view(np.int64), "v": query[root[moved]].view(np.int64)})

    def proposals(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        query = rows["fp"].to_numpy(np.int64).view(np.uint64)
        own = np.flatnonzero(rows["home"].to_numpy(bool))
        search = lambda link: shard_links(query[own], query, parts[key[0] % len(parts)], BLOCK_RADIUS, radius, link)
        degree, forest = np.zeros(len(query), np.int64), Forest(len(query))
        found = [np.empty((0, 2), np.int64)]

        def count(h: np.ndarray, q: np.ndarray) -> None:
            apart = own[h] != q
            np.add(degree, np.bincount(own[h][apart], minlength=len(query)), out=degree)
            np.add(degree, np.bincount(q[apart], minlength=len(query)), out=degree)

        def link(h: np.ndarray, q: np.ndarray) -> None:
            at, crowd = own[h], (degree[own[h]] > 2 * CROWDED) & (degree[q] > 2 * CROWDED)
            forest.link(at[crowd], q[crowd])
            alone = ~crowd & (at != q)
            a, b = query[at[alone]].view(np.int64), query[q[alone]].view(np.int64)
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))

        search(count)
        search(link)
        once = np.unique(np.concatenate(found), axis=0)
        root = forest.find(np.arange(len(query)))
        moved = np.flatnonzero(root != np.arange(len(query)))
        u, v = (np.concatenate([once[:, i], query[x].view(np.int64)]) for i, x in enumerate((moved, root[moved])))
        return pd.DataFrame({"u": u, "v": v, "crowd": np.arange(len(u)) >= len(once)})

    small_batches(nodes.sparkSession)
    routed = nodes.select("fp").mapInArrow(route, "shard int, fp long, home boolean")
    if propose:
        return routed.groupBy("shard").applyInPandas(proposals, "u long, v long, crowd boolean")
    return routed.groupBy("shard").applyInPandas(pairs, "u long, v long")


def classes(docs: DataFrame, radius: int = RADIUS, terms: int = TERMS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, fp of every row; fp, its number of rows n, root, component_id of every fingerprint)."""
    rows, _ = materialize(fingerprints(docs, terms), "fingerprints")
    nodes, nodes_path = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    roots = components(links(nodes, radius))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    found, _ = materialize(placed.join(named, "root").select("fp", "n", "root", "component_id"), "classes")
    discard(docs.sparkSession, nodes_path)
    return rows, found


def simhash_components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (smallest doc_id reachable by links)."""
    rows, found = classes(docs, radius)
    return join_groups(rows, found, "fp", "n", rows.count()).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


#: Similarity of verified links: shared shingles of `VERIFY_TERMS` words, as a share of all, are at least 4 in 5.
VERIFY_TERMS = 5
#: Fingerprints in a shard of the wide search: fewer shards overlap less.
WIDE_LEAF = 1 << 16
#: Texts of one fingerprint up to which each pair of them is compared.
FULL = 8


def verified_classes(docs: DataFrame, radius: int, terms: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, fp of every row; th, its number of rows n, and its class: kind, root).

    Fingerprints within `radius` only propose pairs of texts. Of these, the
    pairs whose sets of five-word shingles have a Jaccard similarity of 0.8 or
    more are the links of the components. Texts with one set are one node.
    Sets are of 64-bit hashes, and only those of proposed texts move. Where
    fingerprints crowd, the texts around them are one crowd, whose similar
    pairs are connected without comparing all of them, within `radius` or not.
    """
    rows, _ = materialize(fingerprints(docs, terms), "fingerprints")
    texts, _ = materialize(rows.groupBy("th").agg(F.first("fp").alias("fp"), F.count(F.lit(1)).alias("n")), "texts")
    nodes, _ = materialize(texts.groupBy("fp").agg(F.count(F.lit(1)).alias("texts")), "nodes")
    # Fingerprints of many texts are crowds of their own, and so is what is near them.
    full = nodes.filter(F.col("texts") > FULL).select("fp")
    end = lambda x: full.select(F.col("fp").alias(x), F.lit(True).alias(f"full_{x}"))
    seen = links(nodes, radius, WIDE_LEAF, propose=True).distinct().join(end("u"), "u", "left").join(end("v"), "v", "left")
    near, _ = materialize(seen.select("u", "v", (F.col("crowd") | F.coalesce("full_u", "full_v", F.lit(False))).alias("crowd")), "near")
    proposed = near.select(F.col("u").alias("fp")).union(near.select("v")).union(nodes.filter("texts > 1").select("fp")).distinct()
    wanted = texts.join(proposed, "fp", "left_semi").select("th", "fp")
    bodies = docs.select(F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text")).join(wanted, "th").dropDuplicates(["th"])
    split = bodies.select("th", "fp", words(ascii_lower(F.col("text"))).alias("w"))
    hashes = F.transform(shingles(F.col("w"), VERIFY_TERMS), lambda x: F.xxhash64(F.concat_ws(" ", *[x[f"w{i}"] for i in range(VERIFY_TERMS)])))
    held = split.select("th", "fp", F.sort_array(F.array_distinct(hashes)).alias("set"))
    sets, _ = materialize(held.select("th", "fp", F.xxhash64("set").alias("k"), F.size("set").alias("size"), "set"), "shingle-sets")
    members = sets.select("fp", "k", "size").distinct()
    one, two = [members.select(F.col("fp").alias(x), F.col("k").alias(f"k{x}"), F.col("size").alias(f"size{x}")) for x in ("u", "v")]
    equal = one.join(full, F.col("u") == F.col("fp"), "left_anti").join(two, F.col("u") == F.col("v"))
    met = near.filter("NOT crowd").drop("crowd").join(one, "u").join(two, "v").union(equal.select("v", "u", "ku", "sizeu", "kv", "sizev"))
    # The smaller set is at least 4 in 5 of the larger one where the similarity is.
    close = met.filter((F.col("ku") != F.col("kv")) & (F.least("sizeu", "sizev") * 5 >= F.greatest("sizeu", "sizev") * 4))
    pairs = close.select(F.least("ku", "kv").alias("u"), F.greatest("ku", "kv").alias("v")).distinct()
    known = sets.select("k", "set").dropDuplicates(["k"])
    crowded = near.filter("crowd").select("u", "v")
    around = crowded.select(F.col("u").alias("fp")).union(crowded.select("v")).union(full).distinct()
    joined = around.join(components(crowded), F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("crowd"))
    verified = similar(pairs, known).union(crowd_links(sets.join(joined, "fp").select("crowd", "k", "set")))
    roots = components(verified)
    placed = sets.select("th", "k").join(roots, F.col("k") == F.col("node"), "left").select("th", F.coalesce("root", "k").alias("root"))
    kinds = texts.join(placed, "th", "left").select("th", "n", F.col("root").isNotNull().alias("kind"), F.coalesce("root", "th").alias("root"))
    found, _ = materialize(kinds, "classes")
    return rows, found


def near_dedup(docs: DataFrame, radius: int = RADIUS, terms: int = TERMS) -> DataFrame:
    """The one document of each verified component that stays, with all its columns: the smallest doc_id, of equals one text, of repeated rows one.

    Rows without doc_id stay only where their component has no other.
    """
    rows, found = verified_classes(docs, radius, terms)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "th")
    best = join_groups(rows, found, "th", "n", rows.count()).groupBy("kind", "root").agg(F.min(order).alias("best")).select(F.col("best.doc_id").alias("_id"), F.col("best.th").alias("_th"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"))
    kept = keyed.join(best, keyed["id"].eqNullSafe(best["_id"]) & (keyed["key"] == best["_th"]), "left_semi")
    first = F.row_number().over(Window.partitionBy("id", "key").orderBy("key"))
    return kept.withColumn("place", first).filter("place = 1").select("row.*")
