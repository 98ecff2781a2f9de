from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridspark.llm import packing, segments
from gridspark.llm.queries import BYTES, QUERIES

PATH = public_tokenizers.path(BYTES)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def odd_texts(rng, n=300):
    signs = ["a", "b ", " ", "  ", "\n", " \n ", "\t", "'s", "é", "—", "\xa0", " ", "日", "😀", "<|endoftext|>", "12", "!", "\x85", "ß ", "　", "\x1c", "word "]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def check(rows, ids, size):
    """Pieces tile their documents and sequences; returns the sequences' fills."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for doc, own in by_doc.items():
        at = 0
        for k, r in enumerate(sorted(own, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and 0 < r["length"] <= size and (k == 0 or r["length"] == size)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[doc][at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids[doc]) and len(own) == -(-at // size)
    fills = {}
    for seq, own in by_seq.items():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
        fills[seq] = at
    return fills


def test_segments_have_the_texts_tokens(tokenizer):
    import pyarrow as pa

    vocabulary = packing.Vocabulary(PATH, plain=False)
    texts = odd_texts(random.Random(1), 3000)
    distinct, index, cuts = segments.split(pa.array(texts))
    ids = [x.tolist() for x in np.split(*(lambda v, n: (v, np.cumsum(n)[:-1]))(*vocabulary.encode(distinct.to_pylist())))]
    for i, text in enumerate(texts):
        assert [x for k in index[cuts[i] : cuts[i + 1]] for x in ids[k]] == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_documents(spark, tokenizer):
    rng = random.Random(2)
    texts = [*odd_texts(rng), None, "", "x" * 9000, "word " * 5000, "same text.", "same text."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    out = packing.pack_documents(df, PATH, 256).collect()
    fills = check(out, ids, 256)
    assert len(fills) == -(-sum(map(len, ids.values())) // 256)


def test_best_fit_and_bounds():
    rng = np.random.default_rng(3)
    for size in (10, 64, 2048):
        for _ in range(20):
            lengths = rng.integers(1, size + 1, 200)
            bins, offset, room = packing.best_fit(lengths, size)
            fill = np.bincount(bins, lengths)
            assert (fill <= size).all() and (room == size - fill[bins]).all() and (offset + lengths <= size).all()
            assert packing.least_bins(np.bincount(lengths, minlength=size + 1), size) <= bins.max() + 1
    # three of a third and one above: halves can't share, which sums alone don't see
    assert packing.least_bins(np.bincount([6, 6, 6, 6], minlength=11), 10) == 4
    assert packing.least_bins(np.bincount([4] * 9, minlength=11), 10) == 5


def smallest(lengths, size):
    """The least number of bins, by trying all."""
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for r in set(x for x in rooms if x >= lengths[k]):
            left = list(rooms)
            left.remove(r)
            place(k + 1, [*left, r - lengths[k]])
        place(k + 1, [*rooms, size - lengths[k]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best


def test_bounds_hold_against_all_packings():
    rng = random.Random(4)
    for _ in range(150):
        lengths = [rng.randint(1, 12) for _ in range(rng.randint(1, 9))]
        assert packing.least_bins(np.bincount(lengths, minlength=13), 12) <= smallest(lengths, 12)


def test_exchange_between_partitions(spark):
    """Partitions of 128 pieces leave room that exchanges fill."""
    rng = random.Random(5)
    lengths = [rng.randint(1, 90) for _ in range(3000)]
    pieces = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "row long, piece int, length long")
    out = packing.pack(pieces, 100, group=128).collect()
    fills: dict = {}
    for r in out:
        fills[r["sequence_id"]] = fills.get(r["sequence_id"], 0) + r["length"]
    bound = packing.least_bins(np.bincount(lengths, minlength=101), 100)
    alone = packing.pack(pieces, 100, group=128, rounds=0).select("sequence_id").distinct().count()
    assert len(out) == 3000 and max(fills.values()) <= 100 and bound <= len(fills) < alone
    assert len(fills) <= bound * 1.03


def test_edges(spark, docs, clashing, empty):
    assert packing.pack_documents(empty.select("doc_id", "text"), PATH).count() == 0
    out = packing.pack_documents(clashing, PATH)
    assert "slot" in out.columns and out.columns.count("size") == 1
    assert out.select("doc_id").distinct().count() == docs.count()
    nulls = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")
    assert packing.pack_documents(nulls, PATH).count() == 3


def test_query(spark, tokenizer):
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    ids = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in texts}
    fills = check(QUERIES["op12_best_fit_packing"](spark, SF).collect(), ids, 2048)
    counts = np.zeros(2049, np.int64)
    for own in ids.values():
        counts[2048] += (len(own) - 1) // 2048
        counts[(len(own) - 1) % 2048 + 1] += 1
    assert packing.least_bins(counts, 2048) <= len(fills) <= packing.least_bins(counts, 2048) + 1
