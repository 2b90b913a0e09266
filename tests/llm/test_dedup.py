"""Suffix-array dedup, SimHash near-dedup, line dedup, packing."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from quern.llm.graph import components
from quern.llm.line_dedup import cleaned, line_dedup
from quern.llm.packing import Ids, best_fit, cut, sweeps
from quern.llm.queries import tokenizer
from quern.llm.simhash_dedup import Forest, Tree, blocks, links, near_dedup, shard_links, simhash_components
from quern.llm.suffix_dedup import remove_repeats, runs, sort_batch, text_anchors, whole_groups, windows, without_repeats
from tests.llm.helpers import awkward, nothing, texts


def covered(raws, length):
    """Brute force: which bytes a repeated string covers."""
    seen = Counter(t[i : i + length] for t in raws for i in range(len(t) - length + 1))
    out = []
    for t in raws:
        mask = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mask[i : i + length] = True
        out.append(mask)
    return out


def sharded(raws, length, k, batch):
    anchored = [[tuple(a) for a in text_anchors(t, length, k)] for t in raws]
    count = Counter(h for doc in anchored for a in doc for h in a[3].tolist())
    fragments = []
    for d, doc in enumerate(anchored):
        for p, first, last, h, _ in doc:
            for at, a, b, key, g in zip(p.tolist(), first.tolist(), last.tolist(), h.tolist(), h.view(np.int64).tolist()):
                if count[key] > 1:
                    fragments.append((g, d, at, a, b, raws[d][at - b : at - a + length]))
    random.shuffle(fragments)
    fragments.sort(key=lambda f: f[0])
    masks = [np.zeros(len(t), bool) for t in raws]
    kinds = dict(shard=pa.int64(), d=pa.int64(), p=pa.int64(), first=pa.int64(), last=pa.int64(), raw=pa.binary())
    table = pa.table([pa.array([f[i] for f in fragments], t) for i, t in enumerate(kinds.values())], list(kinds))
    seen = []
    for part in whole_groups(iter(table.to_batches(max_chunksize=7)), "shard", batch):
        seen += sorted(set(part["shard"].to_pylist()))
        group, d, p, first, last = (part[c].to_numpy() for c in list(kinds)[:5])
        pieces = part["raw"].to_pylist()
        for row, a, b in zip(*sort_batch(group, first, last, np.frombuffer(b"".join(pieces), np.uint8), np.r_[0, np.cumsum([len(x) for x in pieces])], length)):
            masks[d[row]][p[row] - b : p[row] - a + length] = True
    assert len(seen) == len(set(seen)), "a group in two batches"
    return masks


def test_shards_of_any_size_equal_brute_force():
    random.seed(5)
    for _ in range(12):
        length, k = random.choice([20, 33, 40]), random.choice([4, 8, 11])
        letters = random.choice([b"ab", b"abcdefgh", b"\x00\x01a"])
        base = [bytes(random.choice(letters) for _ in range(random.randint(0, 300))) for _ in range(5)]
        raws = list(base)
        for _ in range(10):
            t = bytearray(random.choice(base))
            for _ in range(random.randint(0, 3) if t else 0):
                i = random.randrange(len(t))
                t[i : i + random.randint(0, 3)] = bytes(random.choice(letters) for _ in range(random.randint(0, 5)))
                if not t:
                    break
            raws.append(bytes(t))
        raws += [b"abc" * 60, b"\x00" * 50]
        want = covered(raws, length)
        for batch in (10**6, 50, 1):
            assert all((a == b).all() for a, b in zip(want, sharded(raws, length, k, batch)))


def test_hashes_follow_the_content_alone():
    random.seed(15)
    part = bytes(random.choice(b"abcdef ") for _ in range(900))
    raws = [b"x" * 300 + part, part + b"y" * 77, bytes(random.choice(b"abc") for _ in range(400)) + part + b"z" * 210]
    for length, k in ((200, 56), (40, 11)):
        of = {}
        for raw in raws:
            for p, first, last, h, f in text_anchors(raw, length, k):
                for at, a, b, x, y in zip(p.tolist(), first.tolist(), last.tolist(), h.tolist(), f.tolist()):
                    of.setdefault((x, y), set()).add((a, b, raw[at - b : at - a + length]))
            assert len(windows(raw, length, k)) == len(raw) - length + 1
        assert all(len(x) == 1 for x in of.values())
        by = {}
        for raw in raws:
            for i, w in enumerate(windows(raw, length, k).tolist()):
                by.setdefault(w, set()).add(raw[i : i + length])
        assert all(len(x) == 1 for x in by.values()) and len(by) == len(set().union(*by.values()))


def test_periodic_runs_keep_two_anchors():
    raw = b"Is onhe. " * 100
    (p, first, last, h, _), = text_anchors(raw)
    stay, extent = runs(raw, p, first, last, h)
    assert stay.sum() < 12 and extent.max() > 300


def test_remove_repeats(spark):
    random.seed(6)
    base = ["".join(random.choice("abcdefgh ") for _ in range(600)) for _ in range(4)]
    more = [(100 + i, t, None, None, None) for i, t in enumerate([base[0], base[0][50:500] + base[1][:250], base[1] + base[1][:210], "a" * 201, "b" * 200, "c" * 199, base[2] + "Is onhe. " * 40, base[3], base[3], "é" * 150])]
    docs = awkward(spark, more)
    rows = texts(docs)
    raws = [t.encode() for _, t in rows]
    want = Counter()
    for (i, _), raw, mask in zip(rows, raws, covered(raws, 200)):
        kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
        want[(i, len(raw), int(mask.sum()), int((np.diff(np.r_[0, mask.astype(np.int8)]) == 1).sum()), hashlib.sha256(kept).hexdigest())] += 1
    assert Counter(map(tuple, remove_repeats(docs).collect())) == want
    # Every shared anchor counted window by window, and batches of one group.
    assert Counter(map(tuple, remove_repeats(docs, batch=1, hot=1, kinds=0).collect())) == want
    assert Counter(map(tuple, remove_repeats(docs, batch=3, hot=3, kinds=0).collect())) == want
    assert remove_repeats(nothing(spark)).count() == 0
    kept = without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() and kept.filter("doc_id = 104 AND text = ''").count() == 0
    assert kept.filter("doc_id = 107").first()["text"] == ""


def test_many_equal_rows_cost_what_one_does(spark):
    random.seed(7)
    text = " ".join(str(random.randrange(10**6)) for _ in range(450))
    rows = [(1, text)] * 10_000 + [(2, text[:400] + "!" * 300), (3, "z" + text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = Counter(map(tuple, remove_repeats(docs).collect()))
    empty = hashlib.sha256(b"").hexdigest()
    n = len(text)
    assert found[(1, n, n, 1, empty)] == 10_000 and found[(3, n + 1, n, 1, hashlib.sha256(b"z").hexdigest())] == 1
    assert sum(found.values()) == 10_002 and [r[2] for r in found if r[0] == 2] == [700]


def fingerprint(text):
    t = text.translate({i: i + 32 for i in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    h = np.array([xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))], np.uint64)
    votes = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0)
    return int(sum(1 << i for i in range(64) if 2 * votes[i] > len(h)))


def test_simhash_components(spark):
    docs = awkward(spark, [(50, "ÀB c d", None, None, None), (51, "Àb C\x0bd ", None, None, None), (52, "same words here now", None, None, None), (53, "Same WORDS here now", None, None, None)])
    rows = texts(docs)
    fps = np.array([fingerprint(t) for _, t in rows], np.uint64)
    forest = Forest(len(rows))
    for i in range(len(rows)):
        j = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3)
        forest.link(np.full(len(j), i), j)
    root = forest.find(np.arange(len(rows)))
    least = {r: min((rows[i][0] for i in np.flatnonzero(root == r) if rows[i][0] is not None), default=None) for r in set(root.tolist())}
    want = Counter((i, f"{int(f):016x}", least[r]) for (i, _), f, r in zip(rows, fps, root.tolist()))
    assert Counter(map(tuple, simhash_components(docs).collect())) == want
    assert simhash_components(nothing(spark)).count() == 0
    kept = near_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(least)
    assert near_dedup(nothing(spark)).count() == 0


def clustered(n, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, k, False).astype(np.uint64)) for k in rng.integers(1, 6, n)], np.uint64)
    return np.unique(np.r_[base, base ^ flips, base[:20] ^ np.uint64(1 << 40)])


@pytest.mark.parametrize("radius", [3, 5, 7])
def test_trees_lose_no_pair(radius):
    values = clustered(1200)
    pairs = {(i, int(j)) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= radius) if j > i}
    found = set()
    for part in blocks(radius):
        tree = Tree(part(values)[::3], 16, 1)
        index, leaf, home = tree.route(part(values))
        assert tree.leaves > 8 and sorted(index[home].tolist()) == list(range(len(values)))
        for shard in range(tree.leaves):
            q, own = index[leaf == shard], index[(leaf == shard) & home]
            shard_links(values[own], values[q], part, 1, radius, lambda h, x, own=own, q=q: found.update((min(a, b), max(a, b)) for a, b in zip(own[h].tolist(), q[x].tolist()) if a != b))
    assert found == pairs


def test_links_connect_over_shards(spark):
    values = clustered(400, 9)
    nodes = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    roots = {r["node"]: r["root"] for r in components(links(nodes, 3, leaf=64)).collect()}
    forest = Forest(len(values))
    for i in range(len(values)):
        j = np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3)
        forest.link(np.full(len(j), i), j)
    root = forest.find(np.arange(len(values)))
    signed = values.view(np.int64).tolist()
    groups = {}
    for v, r in zip(signed, root.tolist()):
        groups.setdefault(r, set()).add(v)
    for members in groups.values():
        assert {roots.get(v, v) for v in members} == {min(members)}


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (7, 7), (200, 201), (200, 201)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(1, 61)} | {101: 100, 102: 100, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_line_dedup(spark):
    common, near, few = "on every site", "on ten sites", "on nine sites"
    more = [(200 + i, f"own line {i}\n{common}\n \n{near if i < 10 else ''}\n{few if i < 9 else ''}\n{common}", None, f"site{i}", None) for i in range(30)]
    docs = awkward(spark, more)
    found = {r["doc_id"]: r for r in line_dedup(docs).collect() if r["doc_id"] is not None}
    assert line_dedup(docs).count() == docs.count()
    assert found[200]["n_removed"] == 1 and found[201]["n_removed"] == 3 and found[209]["n_removed"] == 3 and found[215]["n_removed"] == 2
    assert found[201]["kept_sha256"] == hashlib.sha256(f"own line 1\n \n{few}".encode()).hexdigest()
    assert found[11]["n_removed"] == 0 and found[0]["n_lines"] == 1
    assert line_dedup(nothing(spark)).count() == 0
    kept = cleaned(docs).select("row.*")
    assert kept.columns == docs.columns and kept.filter("doc_id = 0").first()["text"] is None


def test_sweeps_place_all_without_overlap():
    random.seed(8)
    for capacity in (8, 64, 1024):
        counts = dict(Counter(random.randint(1, capacity) for _ in range(400)))
        used, filled = Counter(), {}
        for length, rank, number, first, each, at in sweeps(counts, capacity):
            for r in range(number):
                s, o = first + r // each, at + r % each * length
                filled.setdefault(s, []).append((o, length))
                used[length] += 1
        assert used == counts
        for places in filled.values():
            end = 0
            for o, n in sorted(places):
                assert o == end
                end += n
            assert end <= capacity
        assert len(filled) <= 1.25 * -(-sum(k * v for k, v in counts.items()) // capacity) + 1
    assert sweeps({}) == [] and cut(1, 4) == [(0, 1)] and cut(8, 4) == [(0, 4), (4, 4)] and cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_ids_of_many_texts_equal_the_library(monkeypatch):
    from tests.llm.test_digests import plain_texts

    path = tokenizer("byte_bpe_50k.json")
    one, ids, texts = Tokenizer.from_file(path), Ids(path), plain_texts()
    want = [np.array(one.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(ids.many(texts)) == want and list(ids.many([])) == [] and list(ids.many(["", ""])) == [b"", b""]
    assert [ids(t) for t in texts[-40:]] == want[-40:]
    # Words of plain texts are merged together, none by a call of its own.
    monkeypatch.setattr(ids, "known", None)
    plain = ["It's plain prose, and l'été has 2 or 3 words.\n", "one more"]
    assert list(ids.many(plain)) == [np.array(one.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in plain]


def test_packing(spark):
    import zlib

    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    docs = awkward(spark)
    found = best_fit(docs, path).collect()
    library = Tokenizer.from_file(path)
    want = Counter()
    for i, t in texts(docs):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        want.update((i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(cut(len(ids), 1024)))
    assert Counter(tuple(r)[:5] for r in found) == want
    ends = {}
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 1024
    assert best_fit(nothing(spark), path).count() == 0
