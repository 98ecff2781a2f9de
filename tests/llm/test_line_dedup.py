from __future__ import annotations

from collections import Counter, defaultdict

from gridspark.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"


def brute(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(SPACE).translate(lower)
    held = defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(i)
    gone = {k: max(d) for k, d in held.items() if len(k) >= 20 and len(d) >= 3}
    out = {}
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if gone.get(key(x), i) == i]
        out[i] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return out


def test_against_brute_force(docs, corpus):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(docs, filter_bits=2**16).collect()}
    want = brute(corpus)
    assert got == want and sum(x[1] for x in want.values()) > 5


def test_full_filters_change_nothing(docs, corpus):
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, filter_bits=64).collect()}
    assert got == {i: x[2] for i, x in brute(corpus).items()}


def test_columns_and_repeats(spark, clashing, corpus):
    out = line_dedup.dedup_lines(clashing, filter_bits=2**16)
    assert Counter(out.columns) == Counter([*clashing.columns, "n_dropped"])
    assert out.filter("shard <> 1 or _id <> 10").count() == 0 and out.count() == len(corpus)
    line = "a line of at least twenty letters"
    rows = spark.createDataFrame([(1, line), (1, line), (1, line), (None, line), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in line_dedup.dedup_lines(rows, filter_bits=2**12).collect()) == [(0, ""), (0, ""), (1, line), (1, line), (1, line)]


def test_empty(empty):
    assert line_dedup.dedup_lines(empty, filter_bits=2**12).collect() == []


def test_long_text(spark):
    line = "  One line of Many that Repeats  "
    long = "\n".join(line if i % 3 == 0 else f"line number {i} stands here alone" for i in range(50_000))
    rows = [(1, long, "x"), (2, line, "y"), (3, f"a\n{line}\nb", "z"), (4, "x" * 2_000_000, "w")]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_dropped string")).collect()}
    assert got == brute(rows) and got[1][1] == 16_667


def test_documents_without_suspects_are_kept_apart(spark, docs, corpus):
    from pyspark.sql import functions as F

    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.struct("lang").alias("_rest"))
    shared = spark.sparkContext.broadcast(line_dedup.twice_filter(texts.select("_text"), 2**16, 20))
    kinds = "_id bigint, _text string, _rest struct<lang:string>"
    with_, without = ([r._id for r in texts.mapInArrow(line_dedup._part(shared, 20, which), kinds).collect()] for which in (True, False))
    losing = {i for i, x in brute(corpus).items() if x[1]}
    assert sorted(with_ + without) == sorted(r[0] for r in corpus) and losing <= set(with_) and len(without) > 10


def test_filter_size(spark, docs, corpus):
    lines = sum(len((t or "").split("\n")) for _, t, *_ in corpus)
    assert line_dedup.filter_size(docs, "text", 2**29) == max(2**16, 1 << (16 * lines).bit_length())
    assert line_dedup.filter_size(docs, "text", 2**10) == 2**10
