"""The pipeline, stage by stage against plain models of what each stage decides."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as e
import corpus_pipeline
from gridspark.llm import bpe, mixing, quality
from gridspark.llm._shared import materialize
from gridspark.llm.queries import quality_model

from .test_line_dedup import brute
from .test_near_copies import brute_kept, shingle_set

SF = "/root/testdata/sf0.001"


def test_registered():
    assert {f"op{n}" for n in range(1, 11)} | {"pipeline"} == {k.split("_")[0] for k in e.queries() if k.startswith("op") or k == "pipeline"}
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mixing", "tokens"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        done = materialize(stage(spark, docs, SF), name)
        out.append((docs.collect(), done.collect()))
        docs = done
    return out


def test_quality_stage(spark, stages):
    before, after = stages[0]
    model = quality_model(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    score = model.score(np.array([quality.features(r.text.encode()) for r in before]))
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r, s in zip(before, score, strict=True) if s >= 0.5)
    assert 0 < len(after) < len(before)


def test_line_stage(stages):
    before, after = stages[1]
    want = brute(before)
    assert {r.doc_id: r.text for r in after} == {i: x[2] for i, x in want.items()} and all(r.n_chars == len(r.text) for r in after)


def test_near_duplicate_stage(stages):
    before, after = stages[2]
    assert [(False, r.doc_id) for r in sorted(after, key=lambda r: r.doc_id)] == brute_kept([(r.doc_id, r.text) for r in before])


def test_mixing_stage(spark, stages):
    before, after = stages[3]
    want = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(before)).collect()}
    assert Counter(r.doc_id for r in after) == Counter({i: n for i, n in want.items() if n})


def test_token_stage(stages):
    before, after = stages[4]
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in before}
    assert len(before) == len(after) and all(r.decodes for r in after)
    for r in after:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(texts[r.doc_id])


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["copies", "row", "doc", "id", "digest", "kept", "score", "predicted", "n_lines", "taken", "copy", "ids", "text_sha256", "_id", "_text", "size", "sig"]


def edge_rows():
    """Null and repeated ids, null and empty texts, repeated rows, ties, and a very long text."""
    text = lambda k, n: " ".join(f"k{k}word{i}" for i in range(n))
    texts = [text(k, 30 + k) for k in range(30)] + [None, "", " \n ", text(3, 33), text(3, 33), "a line of more than twenty letters\n" + text(90, 40), "a line of more than twenty letters\n" + text(91, 40), "a line of more than twenty letters\n" + text(92, 40), text(93, 40_000)]
    rows = [(None if i % 7 == 3 else i // 2, t, "en", [None, "a", "b"][i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + rows[5:8]


@pytest.mark.parametrize("name", [s for s, _ in corpus_pipeline.STAGES])
def test_stage_edges(spark, name):
    stage, rows = dict(corpus_pipeline.STAGES)[name], edge_rows()
    table = spark.createDataFrame(rows, SCHEMA)
    wide = table.selectExpr("*", *[f"{k} as `{c}`" for k, c in enumerate(CLASHING)])
    got, more = stage(spark, table, SF), stage(spark, wide, SF)
    assert stage(spark, table.limit(0), SF).collect() == []
    assert got.columns == (table.columns if name != "tokens" else ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "decodes"])
    plain = lambda df: Counter(tuple(r[c] for c in got.columns) for r in df.collect())
    own = plain(got)
    assert own == plain(more)
    if name != "tokens":
        assert more.columns == wide.columns and all(tuple(r)[5:] == tuple(range(len(CLASHING))) for r in more.collect())
    before = Counter((r[0], r[1] or "") for r in rows)
    if name == "quality":
        assert all(n == before[k[0], k[1] or ""] for k, n in own.items())
    if name == "lines":
        assert sum(own.values()) == len(rows) and all(k[4] == len(k[1]) for k in own)
    if name == "near_duplicates":
        assert sorted(((k[0] is None, k[0]) for k in own.elements()), key=lambda x: (x[0], x[1] or 0)) == sorted(((i is None, i) for i, _ in brute_rows(rows)), key=lambda x: (x[0], x[1] or 0))
    if name == "mixing":
        assert all(n <= 3 * before[k[0], k[1] or ""] and (k[1] or "").split() for k, n in own.items())
    if name == "tokens":
        assert sum(own.values()) == len(rows) and all(k[6] for k in own)


def brute_rows(rows):
    """(id, text) of the rows that stay: the first of each group by id (nulls last), then digest."""
    sets = [shingle_set(t) for _, t, *_ in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a == sets[j] or 5 * both >= 4 * (len(a) + len(sets[j]) - both) > 0:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    best = {}
    for (i, t, *_), g in zip(rows, group, strict=True):
        best[g] = min(best.get(g, (True, 2**60, "~", None)), (i is None, i or 0, hashlib.md5((t or "").encode()).hexdigest(), i), key=lambda x: x[:3])
    return [(b[3], b[2]) for b in best.values()]
