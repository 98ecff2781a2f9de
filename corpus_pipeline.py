"""A corpus pipeline of five stages over documents: quality, lines, near-duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes every stage's result to
the shared folder and reads it again.  All stages but the last return the columns of documents.

In every stage each row is a document of its own, whether its id is null, repeated or neither.  Null texts count as empty
ones.  Extra columns pass through all stages but the last, whatever their names.  Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm import bpe, line_dedup, mixing, quality, simhash_similar
from gridspark.llm._shared import materialize, short_batches, table
from gridspark.llm.queries import RANKS, quality_model


def _whole(docs: DataFrame) -> Column:
    """A row as one struct, so that no column name can clash with a stage's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good; equal texts stay or go together."""
    short_batches(spark)
    scored = quality.score(docs.select("doc_id", "text", _whole(docs)), quality_model(spark, docs, sf_dir))
    return scored.filter("predicted = 1").select("doc.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand in three documents or more, but for the largest id's.

    A null text comes out empty, and n_chars is the length of what is left.
    """
    short_batches(spark)
    out = line_dedup.dedup_lines(docs.select("doc_id", "text", _whole(docs)))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(dict(docs.dtypes)["n_chars"])}
    return out.select(*[new[c].alias(c) if c in new else F.col("doc").getField(c).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by SimHash (five-word shingles, similarity 0.8 or more), the smallest id's.

    Of a group, a row with an id stays before one without, then the one with the smaller digest of its text; of rows that
    repeat both, one stays.  Texts without words are one group.
    """
    short_batches(spark)
    keep = simhash_similar.components(docs.select("doc_id", "text"), shingle=5, alike=0.8).select(F.col("doc_id").alias("kept"), F.col("digest").alias("kept_digest"))
    own = docs.select(_whole(docs), F.col("doc_id").alias("id"), simhash_similar.text_digest(F.col("text")).alias("digest"))
    stay = own.join(keep.hint("shuffle_hash"), own["id"].eqNullSafe(keep["kept"]) & (own["digest"] == keep["kept_digest"]), "left_semi")
    return stay.dropDuplicates(["id", "digest"]).select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; every row is taken by itself, whatever its id.

    Texts without words are in no mix and go; a null source is a source.
    """
    rows = materialize(docs.select(_whole(docs), F.monotonically_increasing_id().alias("row")), "rows")
    mixed = mixing.mix(rows.select("row", "doc.doc_id", "doc.text", "doc.source"), row_col="row")
    copies = mixed.filter("copies > 0 and size > 0").select(F.col("row").alias("taken"), F.col("copies").cast("int").alias("copies"))
    taken = rows.join(copies.hint("shuffle_hash"), rows["row"] == copies["taken"])
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("doc.*")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, n_tokens, ids, decodes): byte-level BPE, and whether decoding gives the text back."""
    short_batches(spark)
    ranks = bpe.read_ranks(public_tokenizers.path(RANKS))
    known = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256")
    ids = bpe.encode(docs.select("doc_id", "text", "lang", "source", "n_chars", known), ranks, public_tokenizers.PATTERN)
    out = bpe.decode(ids, ranks)
    return out.select("doc_id", "lang", "source", "n_chars", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("text_sha256")).alias("decodes"))


STAGES = [("quality", keep_quality), ("lines", drop_lines), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("tokens", encode_tokens)]

#: The classifier, the fingerprints and the merges can't be said in SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
