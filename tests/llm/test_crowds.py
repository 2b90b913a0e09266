"""Links within crowds connect what all pairs connect, with few rows."""

import random

import pandas as pd
from pyspark.sql import functions as F

from quern.llm import simhash_dedup
from quern.llm.crowds import crowd_links


def _similar(a, b):
    return 9 * len(a & b) >= 4 * (len(a) + len(b))


def _parts(keys, pairs):
    up = {k: k for k in keys}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    out = {}
    for k in keys:
        out.setdefault(find(k), set()).add(k)
    return {frozenset(x) for x in out.values()}


def _crowd(rng, sizes, edits, fresh=None):
    """Sets around one base each, with some values exchanged; `fresh`: drawn from so few values that they repeat."""
    for n in sizes:
        base = rng.sample(range(1 << 40), 90)
        for _ in range(n):
            out = set(base)
            x = rng.randint(0, edits)
            out -= set(rng.sample(base, x))
            out |= {base[0] * 7 + rng.randrange(fresh) if fresh else rng.randrange(1 << 40) for _ in range(rng.randint(0, x))}
            yield out


def test_crowds_equal_brute_force(spark):
    rng = random.Random(5)
    crowds = [[*_crowd(rng, (150,), 30)], [*_crowd(rng, (60, 50, 40), 24)], [*_crowd(rng, (100,), 40, 60)], [*_crowd(rng, (1,) * 30, 0), set(), {1}], [*_crowd(rng, (120,), 12)]]
    rows, key = [], 0
    for c, sets in enumerate(crowds):
        for s in sets:
            rows.append((c, key, sorted(s)))
            key += 1
    rows.append((4, 0, rows[0][2]))  # one key in two crowds
    members = spark.createDataFrame(rows, "crowd long, k long, set array<long>")
    links = {(r["u"], r["v"]) for r in crowd_links(members).collect()}
    known = {k: set(s) for _, k, s in rows}
    assert all(_similar(known[a], known[b]) for a, b in links)
    want = [(a, b) for c, a, s in rows for d, b, t in rows if c == d and a < b and _similar(set(s), set(t))]
    assert _parts(known, links) == _parts(known, want)
    assert len(links) < len(want) / 2


def test_proposals_follow_the_fingerprints(spark):
    rng = random.Random(6)
    base = rng.getrandbits(63)
    near = {base ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 5))) for _ in range(1200)}
    values = sorted(near | {rng.getrandbits(63) for _ in range(300)})
    nodes = spark.createDataFrame(pd.DataFrame({"fp": values}))
    found = simhash_dedup.links(nodes, 11, propose=True).distinct().cache()
    # As rows of each pair and shard they were 2 004 094.
    assert simhash_dedup.links(nodes, 11, propose=True).count() < 20 * len(values)
    crowd = _parts(values, [(r["u"], r["v"]) for r in found.filter("crowd").collect()])
    home = {v: i for i, part in enumerate(crowd) for v in part}
    alone = {(r["u"], r["v"]) for r in found.filter(~F.col("crowd")).collect()}
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 11:
                assert (a, b) in alone or home[a] == home[b]
