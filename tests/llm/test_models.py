from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridspark.llm import imatch, langid, quality
from gridspark.llm._shared import held_out

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.01"


def auc(score, y):
    order = np.argsort(np.argsort(score)) + 1.0
    n = y.sum()
    return (order[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_additive_model_learns_interactions():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality.NAMES)))
    y = (((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)) | (x[:, 2] > 0.9)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert (0, 1) in model.pairs and auc(model.score(x[2000:]), y[2000:]) > 0.95
    assert quality.fit(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3


def test_features_are_finite():
    for t in (None, b"", b" ", b"\n\n", b"a" * 200_000, "ß".encode(), b"The The"):
        assert np.isfinite(quality.features(t)).all() and len(quality.features(t)) == len(quality.NAMES)


def test_quality_on_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels.filter(~held_out(F.col("doc_id"))))
    rows = quality.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").filter(held_out(F.col("doc_id"))).collect()
    assert auc(np.array([r.score for r in rows]), np.array([r.quality for r in rows])) > 0.97


def test_quality_edges(spark, docs, empty, clashing, corpus):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0), (None, 1), (3, None), (999, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    out = quality.score(clashing, model, keep_text=True)
    assert sorted(out.columns) == sorted(clashing.columns) and out.filter("shard <> 1 or score < 0 or score > 1").count() == 0 and out.count() == len(corpus)
    assert quality.score(empty, model).collect() == []
    assert quality.train(empty, labels).score(np.zeros((1, len(quality.NAMES)))).tolist() == [0.5]


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = langid.profiles(docs.filter(~held_out(F.col("doc_id"))))
    rows = langid.identify(docs, known).join(docs.select("doc_id", "lang"), "doc_id").filter(held_out(F.col("doc_id"))).collect()
    assert set(known) == {"de", "en", "es", "fr"} and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_language_edges(docs, empty, clashing, corpus):
    known = langid.profiles(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(clashing, known).collect()}
    for i, t, *_ in corpus:
        assert (got[i][0] == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= got[i][1] <= 1
    assert langid.identify(empty, known).collect() == [] and langid.profiles(empty) == {}
    assert all(r.lang_pred == "und" for r in langid.identify(docs, {}).collect())
    parts = langid.grams("Ab c" * 700_000)
    assert parts[1].sum() > 2 * langid.CHUNK  # longer than a chunk


def test_grams():
    keys, counts = langid.grams("aba, x")
    text = lambda k: "".join(chr(int(k) >> s & 0x1FFFFF) for s in (42, 21, 0) if int(k) >> s & 0x1FFFFF)
    assert {text(k): int(n) for k, n in zip(keys, counts, strict=True)} == {"a": 2, "b": 1, "x": 1, " a": 1, "ab": 1, "ba": 1, "a ": 1, " x": 1, "x ": 1, " ab": 1, "aba": 1, "ba ": 1, "a x": 1, " x ": 1}


def plain_grams(text):
    t = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    t = f" {' '.join(t.split())} "
    return Counter(g for n in (1, 2, 3) for i in range(len(t) - n + 1) if (g := t[i : i + n]).strip() and (n > 1 or g != " ")) if t.strip() else Counter()


def rank_list(counts):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], [0] * (3 - len(x[0])) + [ord(c) for c in x[0]]))][: langid.PROFILE]


def test_language_against_brute_force(docs, corpus):
    learned = {}
    for _, t, lang, *_ in corpus:
        if lang:
            learned.setdefault(lang, Counter()).update(plain_grams(t))
    known = {lang: {g: k for k, g in enumerate(rank_list(c))} for lang, c in learned.items()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, langid.profiles(docs)).collect()}
    for i, t, *_ in corpus:
        own = rank_list(plain_grams(t))
        far = {lang: sum(min(langid.PROFILE, abs(ranks[g] - k)) if g in ranks else langid.PROFILE for k, g in enumerate(own)) for lang, ranks in known.items()}
        best = min(sorted(far), key=far.get)
        assert got[i] == (("und", 0.0) if not own else (best, pytest.approx(1 - far[best] / (langid.PROFILE * len(own)))))


def test_scores_are_sums_of_looked_up_bins(docs, corpus):
    labels = docs.sparkSession.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {r.doc_id: (r.score, r.predicted) for r in quality.score(docs, model).collect()}
    assert model.pairs and any(t.any() for t in model.mains)
    for i, t, *_ in corpus:
        x = quality.features((t or "").encode())
        bins = [sum(e <= v for e in edges) for edges, v in zip(model.edges, x, strict=True)]
        z = model.start + sum(float(m[b]) for m, b in zip(model.mains, bins, strict=True))
        z += sum(float(t[model.coarse[a][bins[a]], model.coarse[b][bins[b]]]) for (a, b), t in zip(model.pairs, model.tables, strict=True))
        want = 1 / (1 + np.exp(-z))
        assert got[i] == (pytest.approx(want, abs=1e-9), int(got[i][0] >= 0.5))


def test_imatch(docs, corpus):
    texts = {i: t or "" for i, t, *_ in corpus}
    rows = {r.doc_id: r for r in imatch.fingerprint_edits(docs, ranges=7).collect()}
    ids = sorted(texts)
    assert sorted(rows) == ids
    seen: dict = {}
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        t, half, r = texts[i], len(texts[i]) // 2, rows[i]
        assert (r.n_chars, r.edited) == (len(t), t[: len(t) - half] + texts[j][:half])
        assert len(r.fingerprint) == len(r.edited_fingerprint) == imatch.SUBSETS * 16
        assert seen.setdefault(t, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_next == 1) or r.fingerprint != rows[j].fingerprint


def brute_imatch(texts):
    """Fingerprints (lists of 64-bit hashes) of texts whose lexicon is that of ``corpus``, as a function."""
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    h64 = lambda raw, seed=42: signed(xxhash.xxh64_intdigest(raw, seed % 2**64))
    word = lambda t: {h64(w) for w in t.translate(LOWER).encode().split()}
    df = Counter(w for t in texts for w in word(t))
    known = {w for w, n in df.items() if 0.001 * len(texts) <= n <= 0.01 * len(texts)}

    def fingerprint(t):
        used, out = (word(t) & known) or word(t), [0] * imatch.SUBSETS
        raw = lambda x, size: x.to_bytes(size, "little", signed=True)
        drawn = [(w, h64(raw(k, 4), h64(raw(w, 8))) % imatch.SUBSETS) for w in sorted(used) for k in range(imatch.DRAWS)]
        for j in range(imatch.SUBSETS):
            seed = 42
            for w in [w for w, s in drawn if s == j]:
                seed = h64(raw(w, 8), h64(raw(j, 4), seed))
            out[j] = seed if seed != 42 else 0
        return out

    return fingerprint


def test_imatch_against_brute_force(docs, corpus):
    texts = {i: t or "" for i, t, *_ in corpus}
    model = brute_imatch(list(texts.values()))
    rows = {r.doc_id: r for r in imatch.fingerprint_edits(docs, ranges=5).collect()}
    ids, text = sorted(texts), lambda h: "".join(f"{x % 2**64:016x}" for x in h)
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        a, b, c = model(texts[i]), model(rows[i].edited), model(texts[j])
        assert (rows[i].fingerprint, rows[i].edited_fingerprint) == (text(a), text(b))
        for near, other in ((rows[i].near_edited, b), (rows[i].near_next, c)):
            used = [(x, y) for x, y in zip(a, other, strict=True) if x or y]
            assert near == pytest.approx(1.0 if a == other else sum(x == y for x, y in used) / max(1, len(used)))


def test_imatch_by_its_lexicon(spark):
    """2,000 documents, whose rare words make a lexicon that decides nearly all fingerprints."""
    rng = random.Random(9)
    texts = [" ".join([rng.choice("abcdefgh") for _ in range(6)] + [f"Rare{rng.randrange(6000)}" for _ in range(12)] * (k % 40 > 0)) for k in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    known = imatch.lexicon(df)
    used = {k: len({w.lower() for w in t.split()}) for k, t in enumerate(texts)}
    assert 3000 < len(known) < 6000
    model, text = brute_imatch(texts), lambda h: "".join(f"{x % 2**64:016x}" for x in h)
    rows = {r.doc_id: r for r in imatch.fingerprint_edits(df, ranges=4).collect()}
    for k in range(0, 2000, 7):
        assert rows[k].fingerprint == text(model(texts[k]))
        assert rows[k].edited_fingerprint == text(model(rows[k].edited))
    common = " ".join("abcdefgh")
    assert sum(text(model(texts[k] + " " + common)) == rows[k].fingerprint for k in range(0, 2000, 7) if used[k] > 8) > 250


def test_imatch_long_text(spark):
    rows = [(1, " ".join(f"w{k % 5000}" for k in range(60_000))), (2, "x " * 100_000)]
    got = {r.doc_id: r for r in imatch.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string"), ranges=2).collect()}
    assert got[1].n_chars == len(rows[0][1]) and got[1].near_next < 0.1


def test_imatch_likeness_follows_edits(spark):
    rng = random.Random(5)
    vocabulary = [f"t{k}" for k in range(900)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(120)) for _ in range(300)]
    rows = imatch.fingerprint_edits(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ranges=4).collect()
    assert np.mean([r.near_edited for r in rows]) > np.mean([r.near_next for r in rows]) + 0.05


def test_imatch_edges(spark, empty, clashing, corpus):
    assert imatch.fingerprint_edits(empty).collect() == []
    assert imatch.fingerprint_edits(clashing, ranges=3).count() == len(corpus)
    single = imatch.fingerprint_edits(spark.createDataFrame([(4, "ab cd")], "doc_id long, text string")).first()
    assert (single.edited, single.near_next) == ("ab ab", 1.0)
    rows = imatch.fingerprint_edits(spark.createDataFrame([(2, "bbbb"), (2, "bbbb"), (None, "nn"), (9, None)], "doc_id long, text string"), ranges=3).collect()
    assert sorted((r.doc_id or 0, r.edited) for r in rows) == [(0, "nb"), (2, "bb"), (2, "bbbb"), (9, "")]
