"""The pipeline's near-duplicate and mixing stages on inputs that fingerprints within two bits, or ids alone, get wrong."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridspark.llm import simhash_similar

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_kept(rows):
    """Ids (smallest of each group, ids before nulls) by comparing all pairs of shingle sets."""
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a == sets[j] or 5 * both >= 4 * (len(a) + len(sets[j]) - both) > 0:
                up[find(i)] = find(j)
    groups = {}
    for i, (id_, _) in enumerate(rows):
        groups.setdefault(find(i), []).append((id_ is None, id_))
    return sorted(min(g, key=lambda x: (x[0], x[1] or 0)) for g in groups.values())


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"x{rng.randrange(10**9)}"
    return out


def run(spark, rows):
    table = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], SCHEMA)
    return sorted((r.doc_id is None, r.doc_id) for r in corpus_pipeline.drop_near_duplicates(spark, table, "").collect())


def test_near_copies_against_brute_force(spark):
    rng, rows = random.Random(5), []
    for _ in range(12):  # copies with a few words changed: similarities on both sides of 0.8, and chains of them
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(40, 300))]
        for k in range(6):
            rows.append((len(rows), " ".join(edited(rng, words, k * len(words) // 90))))
            if k == 2:
                words = edited(rng, words, len(words) // 60)
    hub = [f"h{i}" for i in range(200)]  # crowded prefixes whose holders are partly alike
    rows += [(len(rows) + k, " ".join(edited(rng, hub, 1 + k % 9))) for k in range(40)]
    rows += [(500, None), (501, ""), (502, "a b"), (503, "A b"), (504, "a c")]
    rng.shuffle(rows)
    assert run(spark, rows) == brute_kept(rows)


@pytest.mark.parametrize(("crowded", "rounds"), [(None, 3), (2, 3), (2, 0), (10**6, 3)])
def test_crowded_signatures_change_nothing(spark, crowded, rounds):
    rng, rows = random.Random(8), []
    for _ in range(6):  # groups of near copies that are not all alike, as each is edited from another
        words = [f"w{rng.randrange(9000)}" for _ in range(120)]
        for _ in range(40):
            rows.append((len(rows), " ".join(words)))
            words = edited(rng, words, rng.randrange(1, 4)) if rng.random() < 0.9 else edited(rng, words, 30)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((False, r.doc_id) for r in simhash_similar.components(table, crowded=crowded, rounds=rounds, recall=0.999).collect())
    assert kept == brute_kept(rows) and 6 < len(kept) < 100


def test_null_and_repeated_ids_are_rows_of_their_own(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (None, text(3)), (4, text(3)), (7, text(5)), (7, text(6)), (7, text(6)), (8, text(5))]
    assert run(spark, rows) == brute_kept(rows) == [(False, 4), (False, 7), (False, 7), (True, None), (True, None)]
    assert run(spark, []) == []


def test_mixing_takes_rows_not_ids(spark):
    rows = [(i // 3 if i % 5 else None, " ".join(["w"] * (1 + i % 7)), "en", "ab"[i % 2], 0) for i in range(60)]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.monotonically_increasing_id())
    taken = corpus_pipeline.mix_sources(spark, table, "").groupBy("n_chars").count().collect()
    assert max(r["count"] for r in taken) <= 3
    words = {s: sum(len(r[1].split()) for r in rows if r[3] == s) for s in "ab"}
    mixed = corpus_pipeline.mix_sources(spark, table, "").groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()
    want = {"a": min(3 * words["a"], sum(words.values()) * 5 / 7), "b": sum(words.values()) * 2 / 7}
    assert all(abs(r.n - want[r.source]) <= 7 for r in mixed)


def test_candidates_come_from_pigeonholes(spark, monkeypatch):
    """The stage counts bits and collisions over all fingerprints, and its thresholds follow from them."""
    rng, seen, own = random.Random(2), [], simhash_similar.allocate
    rows = [(k, " ".join(f"w{rng.randrange(900)}" for _ in range(60))) for k in range(300)] + [(300, None)]
    monkeypatch.setattr(simhash_similar, "allocate", lambda *a: seen.append((a, own(*a))) or seen[-1][1])
    assert run(spark, rows) == brute_kept(rows)
    (((width, same, agree, n, alike, recall), thresholds),) = seen
    lanes = simhash_similar.lanes_for(*simhash_similar.layout(len(rows), alike, recall))
    bits = np.array([simhash_similar.wide_fingerprint(simhash_similar.shingles(t.encode()), lanes) for _, t in rows[:300]], np.int64)
    both = [bits[:, a : a + 512].T @ bits[:, a : a + 512] for a in range(0, bits.shape[1], 512)]
    parts = [[512 * k + b for b in part] for k, x in enumerate(both) for part in simhash_similar.group_bits(x, 300, width)]
    held = [np.unique(bits[:, p], axis=0, return_counts=True)[1] for p in parts]
    assert n == 300 and same == [float((c * (c - 1)).sum() / 2) for c in held] and len(thresholds) == len(parts)
    assert -1 in thresholds and np.allclose(agree, [np.mean((bits[:, p].mean(axis=0) ** 2) + (1 - bits[:, p].mean(axis=0)) ** 2) for p in parts])


def test_thresholds_reach_the_recall_for_the_least():
    bit = simhash_similar.bits_agree(0.8)
    for n, width, same in ((10**6, 13, [1e4 * (1 + i % 5) for i in range(46)]), (10**4, 12, [10.0] * 20), (300, 8, [1e6 if i < 9 else 1.0 for i in range(30)])):
        got = simhash_similar.allocate(width, same, [0.5] * len(same), n, 0.8, 0.95)
        finds = {-1: 0.0, 0: bit**width, 1: bit**width + width * bit ** (width - 1) * (1 - bit)}
        assert math.prod(1 - finds[t] for t in got) <= 0.05
        used = [s for s, t in zip(same, got, strict=True) if t == 0]
        assert not used or max(used) <= min((s for s, t in zip(same, got, strict=True) if t < 0), default=math.inf)
    assert 1 in simhash_similar.allocate(12, [10.0] * 10, [0.5] * 10, 10**4, 0.8, 0.95)  # too few parts without
    with pytest.raises(ValueError, match="too few parts"):
        simhash_similar.allocate(13, [1.0] * 2, [0.5] * 2, 100, 0.8, 0.99)


def test_pigeonhole_principle():
    """Fingerprints share a signature exactly if a part agrees within its threshold, so always within the sum of t + 1."""
    rng = np.random.default_rng(4)
    parts = np.array_split(rng.permutation(100), 10)
    thresholds = [0, 1, -1, 0, 1, 0, 0, -1, 1, 0]
    probes = simhash_similar.probes_of([p.tolist() for p in parts], thresholds)
    for trial in range(400):
        a, apart = rng.integers(0, 2, 100), np.zeros(100, int)
        apart[rng.choice(100, trial % 40, replace=False)] = 1
        share = any((a[at] == (a ^ apart)[at]).all() for _, at in probes)
        assert share == any(apart[p].sum() <= t for p, t in zip(parts, thresholds, strict=True))
        assert share or apart.sum() >= sum(t + 1 for t in thresholds)


def test_correlated_bits_share_a_part():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2, (2000, 8))
    bits = (base.repeat(4, axis=1) ^ (rng.random((2000, 32)) < 0.05)).astype(np.int64)
    order = rng.permutation(32)
    found = simhash_similar.group_bits(bits[:, order].T @ bits[:, order], 2000, 4)
    assert sorted(sorted(order[p].tolist()) for p in found) == [list(range(k, k + 4)) for k in range(0, 32, 4)]


def test_crowds_make_rows_only_for_pairs_that_are_alike(spark, monkeypatch):
    """Texts that share two thirds of their shingles pass the fingerprints' filters under crowded signatures."""
    rng, rows, sizes, own = random.Random(6), [], {}, simhash_similar.materialize
    hub = [f"h{i}" for i in range(100)]
    rows = [(k, " ".join([*hub, *(f"x{rng.randrange(10**9)}" for _ in range(28 + k % 3))])) for k in range(150)] + [(150 + k, " ".join([*hub, f"y{k}"])) for k in range(20)]

    def seen(df, name):
        out = own(df, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(simhash_similar, "materialize", seen)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((False, r.doc_id) for r in simhash_similar.components(table, crowded=2, rounds=0).collect())
    assert kept == brute_kept(rows) and len(kept) == 151
    assert sizes["crowd"][0] > 1000 and max(sizes["links"]) <= 20 * 19 / 2, sizes
    assert "tried" not in sizes, sizes


def test_only_what_is_outside_the_largest_component_is_marked(spark, monkeypatch):
    """A large group of near copies goes once through the tables of signatures that are left, not once for each join."""
    sizes, own = [], simhash_similar.materialize
    hub, other = [f"h{i}" for i in range(120)], [f"h{i}" for i in range(104)] + [f"o{i}" for i in range(16)]
    rows = [(k, " ".join([*(other if k % 20 == 0 else hub), f"y{k}"])) for k in range(200)]

    def seen(df, name):
        out = own(df, name)
        if {"sig", "part"} <= set(out.columns):
            sizes.append(out.count())
        return out

    monkeypatch.setattr(simhash_similar, "materialize", seen)
    kept = sorted((False, r.doc_id) for r in simhash_similar.components(spark.createDataFrame(rows, "doc_id long, text string"), crowded=2).collect())
    assert kept == brute_kept(rows) and len(kept) == 2
    assert sizes[0] >= 1000 and sum(sizes[1:]) <= sizes[0] / 8, sizes
