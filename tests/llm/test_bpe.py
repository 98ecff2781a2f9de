from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from gridspark.llm import bpe


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["it's we'll I'M 'Tis", "  two  spaces nbsp em \t\n\n x ", "naïve café ÀÉÎ 北京 🙂🙂 ́", "x" * 700 + " " + "ab" * 400, "1234567 ٣٤ ½ Ⅷ", "<|endoftext|>", "\u0085next line", "a\r\n\r\nb   ", "!!!???###" * 40]


def test_against_the_library(spark, docs, corpus, ranks, library):
    texts = {i: t for i, t, *_ in corpus} | {1000 + i: t for i, t in enumerate(ODD)}
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    out = bpe.decode(bpe.encode(rows, ranks, public_tokenizers.PATTERN), ranks).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(texts[r.doc_id] or "")
        assert bytes(r.decoded) == (texts[r.doc_id] or "").encode()


def test_higher_order_fold(spark, ranks, library):
    words = ["the", " hello", "thereofand", "zzzqx", "北", " unbelievablement", "a", ""]
    got = {r.word: r.ids for r in bpe.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), ranks).collect()}
    assert got == {w: library.encode_single_token(w.encode()) and [library.encode_single_token(w.encode())] if w.encode() in ranks else library._encode_single_piece(w) if w else [] for w in words}


def test_long_words_agree(ranks):
    merger = bpe.Merger(ranks)
    import pyarrow as pa

    for word in ("ab" * 100, "zq" * 90 + "the", "x" * 250):
        start, length, ids = merger.encode(pa.array([word]))
        assert ids[start[0] : start[0] + length[0]].tolist() == merger.long_word(word.encode())


def test_edges(empty, clashing, corpus, ranks):
    assert bpe.decode(bpe.encode(empty, ranks, public_tokenizers.PATTERN), ranks).collect() == []
    out = bpe.encode(clashing, ranks, public_tokenizers.PATTERN)
    assert sorted(out.columns) == sorted(c for c in clashing.columns if c != "text") and out.filter("shard <> 1").count() == 0
    assert dict(out.dtypes)["ids"] == "binary" and out.filter(F.col("ids").isNull()).count() == 0


def test_long_text(spark, ranks, library):
    text = " ".join(f"word{k * k % 7919} naïve{k}" for k in range(40_000)) + "z" * 50_000
    out = bpe.decode(bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), ranks, public_tokenizers.PATTERN), ranks).first()
    assert np.frombuffer(out.ids, "<u4").tolist() == library.encode_ordinary(text) and bytes(out.decoded) == text.encode()
