from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

from kmerlake.llm import near_dedup as N
from tests.llm.data import documents, edge_rows, frame

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = (text or "").encode().translate(LOW).split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute(rows):
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {k: (len(s), root(k), root(k) == k) for k, s in sets.items()}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


@pytest.mark.parametrize("group", [512, 4])
def test_brute_force(spark, group):
    """Groups of 4 deal all larger buckets and families into parts."""
    rows = documents(n=200) + edge_rows()
    assert got(N.near_duplicates(frame(spark, rows, True), group=group)) == brute(rows)


def test_short_texts_that_share_none_of_the_first_bands(spark):
    """3 of 4 shingles: of 40,000 such pairs these are the ones that 32 bands miss."""
    rows = []
    for i in (9358, 15812, 28132, 34987):
        w = [f"w{i}x{j}" for j in range(8)]
        rows += [(2 * i, " ".join(w[:7]), "", "", 0), (2 * i + 1, " ".join(w), "", "", 0)]
        a, b = (N.bands(N.signature(N.shingle_set(r[1])))[:32] for r in rows[-2:])
        assert not (a == b).any()
    assert got(N.near_duplicates(frame(spark, rows))) == brute(rows)


def test_a_hot_group_of_near_copies(spark):
    """A third of the documents are near copies of one that isn't the first, far from most of one another."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(240):
        w = [f"v{rng.randrange(10**6)}" for _ in range(60)]
        if i % 3 == 0:
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(60)] = f"c{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "", "", 0))
    assert got(N.near_duplicates(frame(spark, rows), group=16)) == brute(rows)


def test_chain(spark):
    """Each document is near the next only."""
    w = [f"k{i}" for i in range(400)]
    rows = [(i, " ".join(w[i * 8 : i * 8 + 100]), "", "", 0) for i in range(30)]
    assert got(N.near_duplicates(frame(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert got(N.near_duplicates(frame(spark, []))) == {}


def test_similarity_is_estimated_without_bias():
    rng = np.random.default_rng(2)
    share = []
    for _ in range(60):
        x = rng.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = np.unique(x[:350]), np.unique(x[50:])
        share.append((N.signature(a) == N.signature(b)).mean())
    assert abs(np.mean(share) - 300 / 400) < 0.01


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)]
    parent = {x: x for e in links for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    out = {r["id"]: r["comp"] for r in N.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {x: root(x) for e in links if e[0] != e[1] for x in e}


def test_drop_near_copies(spark):
    rows = documents(n=80) + edge_rows()
    df = frame(spark, rows, True)
    out = N.drop_near_copies(df)
    assert out.columns == df.columns
    want = brute(rows)
    assert sorted(map(str, (r["doc_id"] for r in out.collect()))) == sorted(str(r[0]) for r in rows if r[0] is None or want[r[0]][2])
