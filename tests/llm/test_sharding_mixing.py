from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.llm import mixing, sharding


def test_shards(docs, corpus):
    rows = sharding.shard(docs, 4).collect()
    texts = {i: t for i, t, *_ in corpus}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots, home = defaultdict(list), defaultdict(set)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.tokens, r.text_crc32) == (len(raw) + 8, len(raw.split()), zlib.crc32(raw))
        slots[r.shard].append(r.slot)
        home[texts[r.doc_id] or ""].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total = defaultdict(int)
    for i, t in texts.items():
        total[t or ""] += len((t or "").encode()) + 8
    fair = sum(total.values()) / 4
    assert all(len(s) == 1 for t, s in home.items() if total[t] <= fair)
    sums = defaultdict(int)
    for r in rows:
        sums[r.shard] += r["size"]
    assert max(sums.values()) < 1.15 * min(sums.values())


def test_a_hot_group_is_cut(spark):
    rows = [(i, "the same text" if i % 3 else f"text {i} " * (i % 17)) for i in range(3000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8)
    sums = [r.s for r in out.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sums) == 8 and max(sums) < 1.05 * np.mean(sums)
    crc = zlib.crc32(b"the same text")
    assert {(r.text_crc32 == crc, r.cut) for r in out.select("text_crc32", "cut").distinct().collect()} == {(True, True), (False, False)}


def test_all_dimensions_are_balanced_and_equal_texts_stay(spark):
    rng = np.random.default_rng(3)
    texts = [("é" if k % 5 == 0 else "a") * int(rng.integers(1, 30)) + " w" * int(rng.integers(0, 90)) for k in range(2500)]
    rows = [(i, texts[int(rng.integers(0, 2500)) if i % 4 else i % 9]) for i in range(6000)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shard(table, 8, batch=300, weights=(1.0, 1.0, 1.0)).join(table, "doc_id")
    assert out.groupBy("text").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count() == 0
    sums = out.groupBy("shard").agg(F.sum("size"), F.sum("tokens"), F.count("*")).collect()
    assert len(sums) == 8 and all(max(c) < 1.05 * min(c) for c in list(zip(*sums, strict=True))[1:])


def test_place_takes_the_highest_dot_product():
    rng = np.random.default_rng(5)
    share, w = rng.random((60, 3)), np.array([2.0, 1.0, 0.5])
    left = rng.random((5, 3)) + 1
    mine, at = left.copy(), []
    for s in share:
        at.append(max(range(5), key=lambda k: (sum(mine[k][d] * w[d] * s[d] for d in range(3)), -k)))
        mine[at[-1]] -= s
    assert sharding.place(share, left, w).tolist() == at and np.allclose(left, mine)


def test_a_long_text_is_one_row(spark):
    rows = [(1, "w " * 400_000), (2, "w " * 400_000), (3, None), (4, "x")]
    got = {r.doc_id: r for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert (got[1]["size"], got[1].tokens, got[3]["size"]) == (800_008, 400_000, 8) and got[1].shard != got[2].shard  # more bytes than a shard's share: cut


def test_shard_edges(spark, empty, clashing, corpus):
    assert sharding.shard(empty).collect() == []
    assert sharding.shard(clashing).count() == len(corpus)
    rows = spark.createDataFrame([(None, None), (None, "a"), (1, "a"), (1, "a")], "doc_id long, text string")
    assert sorted(r.slot for r in sharding.shard(rows, 1).collect()) == [0, 1, 2, 3]


def brute_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    total, out, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        level = (total - sum(out.values())) / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > 3 * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        out |= {s: 3 * sizes[s] for s in over}
        open_ -= over
    return out


def check_mix(rows, texts, sources):
    sizes = defaultdict(int)
    for i, t in texts.items():
        sizes[sources[i]] += len((t or "").encode().split())
    want, taken, largest = brute_targets(sizes), defaultdict(int), defaultdict(int)
    for r in rows:
        n = len((texts[r.doc_id] or "").encode().split())
        assert r["size"] == n and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * n and r.taken == r.copies * n
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], n)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(1, 0.02 * want[s], largest[s] / 4)


def test_mix(docs, corpus):
    rows = mixing.mix(docs).collect()
    check_mix(rows, {r[0]: r[1] for r in corpus}, {r[0]: r[3] for r in corpus})
    assert len(rows) == len(corpus)
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(3)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def solved(sizes, target):
    """Rates least(3, exp(u * size)) whose words add up to the target, by bisection."""
    s = np.array(sizes, float)
    low, high = -60.0, 60.0
    for _ in range(300):
        u = (low + high) / 2
        low, high = (u, high) if (s * np.minimum(3, np.exp(np.clip(u * s / s.mean(), -700, 700)))).sum() < target else (low, u)
    return np.minimum(3, np.exp(np.clip(low * s / s.mean(), -700, 700)))


def test_rates_solve_the_dual(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60) if i % 17 else rng.integers(1, 900))), ["a", "b", "c", None, "d"][int(rng.choice(5, p=[0.1, 0.5, 0.2, 0.1, 0.1]))]) for i in range(1500)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    for _, g in out.groupby("source", dropna=False):
        own = g[g["size"] > 0]
        target, capped = own["target"].iloc[0], own["target"].iloc[0] == 3 * own["size"].sum()
        want = np.full(len(own), 3.0) if capped else solved(own["size"], target)
        assert np.allclose(own["rate"], want, atol=1e-5) and (capped or own["rate"].round(6).nunique() > 10)
        assert (np.abs(own["copies"] - own["rate"]) < 2).all()


def test_mix_long_text(spark):
    rows = [(1, "w " * 300_000, "a"), (2, "x y", "a"), (3, "z", "b")]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1]["size"] == 300_000 and got[1].source_size == 300_002 and got[3].copies == 3


def test_mix_hot_source_with_ties(spark):
    rows = [(i, "one two three" if i % 3 else "word " * (i % 40), "hot" if i % 3 else f"s{i % 7}") for i in range(900)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    check_mix(out, {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows})


def test_mix_edges(spark, empty, clashing, corpus):
    assert mixing.mix(empty).collect() == []
    assert mixing.mix(clashing).count() == len(corpus)
    rows = spark.createDataFrame([(1, None, None), (2, "", "a"), (None, "x y", "b"), (None, "x y", "b")], "doc_id long, text string, source string")
    got = mixing.mix(rows).collect()
    assert len(got) == 4 and sum(r.taken for r in got) == 4
    nothing = mixing.mix(rows.filter("doc_id is not null")).collect()
    assert [(r.taken, r.target) for r in nothing] == [(0, 0.0), (0, 0.0)]
