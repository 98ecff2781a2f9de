from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from gridspark.llm import alignment
from gridspark.llm.queries import BYTES, PIECES, QUERIES

SF = "/root/testdata/sf0.001"
PATHS = public_tokenizers.path(BYTES), public_tokenizers.path(PIECES)


@pytest.fixture(scope="module")
def vocabularies():
    return alignment.Vocabularies(*PATHS)


def brute(v, texts: dict) -> dict:
    """The contract by whole texts and plain loops over bytes."""
    found, links = {}, {}
    for doc, text in texts.items():
        raw = (" " + (text or "")).encode()
        a, b = ([], []) if not text else (v.a.tokenizer.encode(raw.decode(), add_special_tokens=False).ids, v.b.encode(text))
        if b"".join(v.a_bytes[i] for i in a) != raw or b"".join(v.b_bytes[i] for i in b) != raw:
            a, b = [], []
        owner = [[k for k, i in enumerate(ids) for _ in own[i]] for ids, own in ((a, v.a_bytes), (b, v.b_bytes))]
        pairs = sorted(set(zip(*owner, strict=True)))
        groups, now, last = [], ([], []), (None, None)
        for p, q in pairs:
            if last != (None, None) and p != last[0] and q != last[1]:
                groups.append(now)
                now = ([], [])
            if p not in now[0]:
                now[0].append(p)
            if q not in now[1]:
                now[1].append(q)
            last = p, q
        groups += [now] if pairs else []
        text = ";".join(",".join(str(a[k]) for k in g) + "|" + ",".join(str(b[k]) for k in h) for g, h in groups)
        links[doc] = Counter((a[p], b[q]) for p, q in pairs)
        found[doc] = [len(a), len(b), len(groups), len(pairs), hashlib.sha256(text.encode()).hexdigest() if a else ""]
    count = Counter(p for own in links.values() for p in own)
    highest: dict = defaultdict(int)
    for (a, _), n in count.items():
        highest[a] = max(highest[a], n)
    return {d: (*found[d][:4], sum(n for p, n in own.items() if count[p] == highest[p[0]]), sum(n * count[p] for p, n in own.items()), found[d][4]) for d, own in links.items()}


def rows(df) -> dict:
    return {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in df.collect()}


def odd_texts(n=250):
    rng = random.Random(6)
    signs = ["alpha", "Beta ", " ", "  ", "\n", " \n ", "\t", "'s", "é", "—", "\xa0", "日本", "😀", "<|endoftext|>", "<s> ", "1234", "!?", "▁", "<0x41>", "Übung ", "ﬁ", "the ", "\x00", "é"]
    return ["".join(rng.choice(signs[: 12 if k % 2 else None]) for _ in range(rng.randint(0, 40))) for k in range(n)]


@pytest.mark.parametrize(("chunk", "bucket"), [(1 << 16, 1_000_000), (16, 50)])
def test_against_whole_texts(spark, vocabularies, chunk, bucket):
    """By words, and with nearly every text cut into ranges of 16 bytes and 50 pairs in a bucket."""
    texts = [*odd_texts(), None, "", " ", "x" * 3000, "Same text here.", "Same text here.", "trail ", "the " * 900]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert rows(alignment.align(df, *PATHS, chunk=chunk, pairs_per_bucket=bucket)) == brute(vocabularies, dict(enumerate(texts)))


def test_fragments_are_a_monoid(vocabularies):
    v, rng = vocabularies, random.Random(8)
    for text in odd_texts(80):
        a, b = np.array(v.a.tokenizer.encode(" " + text, add_special_tokens=False).ids, np.int64), np.array(v.b.encode(text), np.int64)
        a_ends, b_ends = np.cumsum(v.a_size[a]), np.cumsum(v.b_size[b])
        if not len(a) or not len(b) or a_ends[-1] != b_ends[-1]:
            continue
        borders = sorted(rng.sample(range(int(a_ends[-1]) + 1), min(4, int(a_ends[-1])))) + [int(a_ends[-1])]
        parts, low = [], 0
        for high in borders:
            i, j = (a_ends > low) & (a_ends <= high), (b_ends > low) & (b_ends <= high)
            parts.append(alignment.fragment(alignment.Stretch(a[i], a_ends[i], b[j], b_ends[j])))
            low = high
        left = parts[0]
        for p in parts[1:]:
            left = left + p
        right = parts[-1]
        for p in parts[-2::-1]:
            right = p + right
        direct = alignment.closed(alignment.Stretch(a, a_ends, b, b_ends))
        for x in (left, right):
            groups, n, links, keys, times = alignment.whole(x)
            assert (groups, n, links, keys.tolist(), times.tolist()) == (direct[0], direct[1], direct[2], direct[3].tolist(), direct[4].tolist())


def test_edges(spark, docs, clashing, empty):
    assert alignment.align(empty, *PATHS).count() == 0
    plain = rows(alignment.align(docs, *PATHS))
    assert rows(alignment.align(clashing, *PATHS)) == plain
    kept = alignment.align(docs, *PATHS, keep_groups=True).collect()
    assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in kept if r["n_a"])
    nulls = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")
    assert sorted(r["n_a"] for r in alignment.align(nulls, *PATHS).collect()) == [0, 2, 2]


def test_query(spark, vocabularies):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert rows(QUERIES["op13_token_alignment"](spark, SF)) == brute(vocabularies, texts)
