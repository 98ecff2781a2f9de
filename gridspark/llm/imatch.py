"""Document fingerprints by I-Match, in DataFrame operations only.

Terms are lower-cased words.  The lexicon keeps those within a band of inverse document frequency; a term must stand in
a fixed share of all documents, so that the lexicon's size is bounded by the distinct terms of a mean document over that
share, however large the corpus.  A fingerprint sorts a document's distinct lexicon terms and hashes, with 64 bits, those
of each of several random sub-lexicons.  Sub-lexicons overlap: every term is in DRAWS of them.  They are small, so that
some of them outlive an edit; two texts are as alike as the share of sub-lexicons on whose terms they agree.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm._shared import WORD, ascii_lower, once

SUBSETS = 96
DRAWS = 2
GROUP = 16  # sub-lexicons that are told apart together, a power of two
BUCKETS = 65536


def terms(text: Column) -> Column:
    """The distinct terms of a text, as 64-bit hashes."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text_col: str = "text", least: float = 0.001, most: float = 0.01) -> list[int]:
    """Hashes of the terms that stand in a share of the documents from ``least`` to ``most``.

    That is the band of idf from log(1 / most) to log(1 / least).  Counted over all rows.  Below 1 / ``most`` documents (100)
    no term can stand in so small a share, the lexicon is empty, and every text is hashed by all its terms.
    """
    n = docs.count()
    own = docs.select(F.explode(terms(F.col(f"`{text_col}`"))).alias("t"))
    band = own.groupBy("t").agg(F.count("*").alias("n")).filter((F.col("n") >= least * n) & (F.col("n") <= most * n))
    return [r.t for r in band.select("t").collect()]


def lexicon_literal(known: list[int]) -> Column:
    """array<array<long>>: a constant with the lexicon's hashes by bucket, found with one look and a short scan."""
    cells: list[list[str]] = [[] for _ in range(BUCKETS)]
    for t in sorted(known):
        cells[t % BUCKETS].append(str(t))
    return F.from_json(F.lit("[" + ",".join(f"[{','.join(c)}]" for c in cells) + "]"), "array<array<bigint>>")


def drawn(t: Column) -> list[Column]:
    """The sub-lexicons that a term is in: the same for every document, as they follow from the term alone."""
    return [F.pmod(F.xxhash64(t, F.lit(k)), F.lit(SUBSETS)).cast("int") for k in range(DRAWS)]


def fingerprint(text: Column, lexicon: Column) -> Column:
    """array<long>: the hash of each sub-lexicon's terms in the text, 0 where it has none.

    A text without lexicon terms is hashed by all its distinct terms, so equal texts have equal fingerprints, and texts
    without terms share one.
    """
    bucket = lambda t: F.element_at(lexicon, (F.pmod(t, F.lit(BUCKETS)) + 1).cast("int"))
    kept = lambda found: once(F.filter(found, lambda t: F.array_contains(bucket(t), t)), lambda k: F.when(F.size(k) > 0, k).otherwise(found))
    used = F.sort_array(once(terms(text), kept))
    # (sub-lexicon, term) pairs in order of the terms; dealt to groups of sub-lexicons first, so that every filter is short
    pairs = F.flatten(F.transform(used, lambda t: F.array(*[F.struct(s.alias("s"), t.alias("t")) for s in drawn(t)])))
    hashed = lambda found: F.when(F.size(found) > 0, F.xxhash64(found)).otherwise(F.lit(0).cast("long"))
    one = lambda ps, j: once(F.filter(ps, lambda p: p["s"] == j), hashed)
    group = lambda ps, g: once(F.filter(ps, lambda p: F.shiftright(p["s"], GROUP.bit_length() - 1) == g), lambda own: F.transform(F.sequence(g * GROUP, g * GROUP + GROUP - 1), lambda j: one(own, j)))
    return once(pairs, lambda ps: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SUBSETS // GROUP - 1)), lambda g: group(ps, g))))


def hex_fingerprint(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the sub-lexicons on which two fingerprints agree, of those where either has terms; 1 for equal fingerprints."""
    both = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    used = F.filter(both, lambda p: (p["x"] != 0) | (p["y"] != 0))
    share = once(used, lambda u: F.try_divide(F.size(F.filter(u, lambda p: p["x"] == p["y"])).cast("double"), F.size(u).cast("double")))
    return F.when(a == b, 1.0).otherwise(F.coalesce(share, F.lit(0.0)))


def with_next(docs: DataFrame, id_col: str, text_col: str, ranges: int) -> tuple[DataFrame, Window]:
    """(doc_id, text, own, bucket, next_text) and the window that orders a bucket.

    Documents are dealt by ranges of ids whose bounds are ids themselves; the documents at a bound also go to the range
    before it (own is false there), and the first ones to the last range, so that every document finds the next one in
    its own range.  Nulls come first, rows that repeat an id in order of their text.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    found = own.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("b"), F.min("doc_id").alias("first"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    first = None if found.nulls else found.first
    bounds = sorted({b for b in found.b or [] if b is not None and b != first})
    last = len(bounds)
    # two short scans instead of one over all bounds: the run of bounds, then the place in it
    width = max(1, int(len(bounds) ** 0.5))
    runs = [bounds[i : i + width] for i in range(0, len(bounds), width)] or [[]]
    heads = F.from_json(F.lit(json.dumps([r[0] for r in runs if r])), "array<bigint>")
    nested = F.from_json(F.lit(json.dumps(runs)), "array<array<bigint>>")
    run = F.size(F.filter(heads, lambda p: p <= F.col("doc_id")))
    own_run = F.element_at(nested, F.greatest(run, F.lit(1)))
    bucket = F.when(run > 0, (run - 1) * width + F.size(F.filter(own_run, lambda p: p <= F.col("doc_id")))).otherwise(0)
    at_bound = F.array_contains(own_run, F.col("doc_id"))
    copies = F.array(F.struct(bucket.alias("bucket"), F.lit(True).alias("own"), F.lit(0).alias("turn")))
    copies = F.concat(copies, F.when(F.coalesce(at_bound, F.lit(False)), F.array(F.struct((bucket - 1).alias("bucket"), F.lit(False).alias("own"), F.lit(0).alias("turn")))).otherwise(F.array().cast("array<struct<bucket:int,own:boolean,turn:int>>")))
    copies = F.concat(copies, F.when(F.col("doc_id").eqNullSafe(F.lit(first)), F.array(F.struct(F.lit(last).alias("bucket"), F.lit(False).alias("own"), F.lit(1).alias("turn")))).otherwise(F.array().cast("array<struct<bucket:int,own:boolean,turn:int>>")))
    dealt = own.select("doc_id", "text", F.explode(copies).alias("c")).select("doc_id", "text", "c.*")
    order = Window.partitionBy("bucket").orderBy("turn", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.withColumn("next_text", F.lead("text").over(order)), order


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next): one row per row of docs.

    edited: the text whose last floor(n_chars / 2) code points are replaced by the first as many (or all) of the next
    document by id (after the last: the first).  Null texts are empty.  Rows that repeat an id follow each other in order
    of their text; a null id comes first.  A single document is its own next.  An empty table gives an empty table.
    """
    ranges = ranges or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = lexicon_literal(lexicon(docs, text_col))
    dealt, order = with_next(docs, id_col, text_col, ranges)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    done = dealt.select("doc_id", "bucket", "own", "turn", "text", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"))
    done = done.select("doc_id", "bucket", "own", "turn", "text", "n_chars", "edited", fingerprint(F.col("text"), known).alias("fingerprint"), fingerprint(F.col("edited"), known).alias("edited_fingerprint"))
    done = done.withColumn("next", F.lead("fingerprint").over(order))
    fp = F.col("fingerprint")
    near = likeness(fp, F.col("edited_fingerprint")).alias("near_edited"), likeness(fp, F.coalesce("next", "fingerprint")).alias("near_next")
    return done.filter("own").select("doc_id", "n_chars", "edited", hex_fingerprint(fp).alias("fingerprint"), hex_fingerprint(F.col("edited_fingerprint")).alias("edited_fingerprint"), *near)
