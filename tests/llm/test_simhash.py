from __future__ import annotations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridspark.llm import simhash
from gridspark.llm.components import connected_components


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[j : j + 3]) for j in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(fps, distance):
    """Smallest id that links reach, by comparing all pairs."""
    ids = sorted(fps)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_against_brute_force(docs, corpus):
    got = {r.doc_id: (r.h, r.component_id) for r in simhash.near_duplicates(docs).withColumn("h", simhash.hex_fingerprint(F.col("fp"))).collect()}
    fps = {i: brute_fingerprint(t) for i, t, *_ in corpus}
    assert {i: int(h, 16) for i, (h, _) in got.items()} == fps and all(len(h) == 16 for h, _ in got.values())
    assert {i: c for i, (_, c) in got.items()} == roots(fps, 2)


@pytest.mark.parametrize("crowded", [64, 2])
def test_clusters_and_crowded_buckets(spark, crowded):
    rng = np.random.default_rng(3)
    centres = [int(x) for x in rng.integers(0, 2**63, 6)]
    fps = {}
    for c in centres:
        at = c
        for _ in range(40):  # chains of close fingerprints, and some far ones
            at ^= 1 << int(rng.integers(64))
            fps[len(fps)] = at
            if rng.random() < 0.3:
                at ^= (1 << int(rng.integers(64))) | (1 << int(rng.integers(64)))
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    table = spark.createDataFrame([(i, signed(x)) for i, x in fps.items()], "rep long, fp long").groupBy("fp").agg(F.min("rep").alias("rep"))
    found = {r.node: r.root for r in connected_components(simhash.links(table, 2, crowded=crowded)).collect()}
    want = roots({min(j for j in fps if fps[j] == x): x for x in fps.values()}, 2)
    assert {i: found.get(i, i) for i in want} == want


@pytest.mark.parametrize(("parts", "distance"), [(2, 2), (3, 2), (4, 2), (4, 3)])
def test_thresholds_cover_every_pair(parts, distance):
    rng = np.random.default_rng(1)
    both = np.eye(64) * 50
    layout = simhash.group_bits(both, 100, parts)
    assert sorted(b for p in layout for b in p) == list(range(64))
    _, ts = simhash.allocate(layout, [5.0] * parts, both, 100, distance)
    assert sum(ts) == distance - parts + 1
    for _ in range(300):
        flips = set(rng.choice(64, distance, replace=False).tolist())
        assert any(len(flips & set(p)) <= t for p, t in zip(layout, ts, strict=True))


def test_edges(spark, empty, clashing, corpus):
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.near_duplicates(clashing).count() == len(corpus)
    rows = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "x y z"), (7, None), (9, " ")], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.component_id or -1) for r in simhash.near_duplicates(rows).collect())
    assert got == [(-1, -1), (-1, 5), (5, 5), (5, 5), (7, 7), (9, 7)]


def test_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(1000, 999), (999, 1000), (4, 4)], "u long, v long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1000: 999}


def test_long_texts_and_other_distances(spark):
    for n in (65_536 + 2, 65_536 + 3, 140_000):
        text = " ".join(f"w{i % 50_000 * i}" for i in range(n))
        assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)
    with pytest.raises(ValueError, match="distance 2"):
        simhash.links(spark.createDataFrame([(1, 1)], "rep long, fp long"), 3)
