"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the corpus contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hand at most ``rows`` documents to a Python worker at once in this session, as texts may be long.

    Spark's own bound on the bytes of a batch (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB) stays as it is.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session (one process, as in tests) gets a temporary folder; a cluster is refused, as its
    executors could not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it again: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pack(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _text, _rest): every other column goes into one struct, so no column name can clash."""
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    struct = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(0).alias("none"))
    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), struct.alias("_rest"))


def unpack(df: DataFrame, docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """The columns of docs again in their order, then more."""
    names = {id_col: "_id", text_col: "_text"}
    cols = [F.col(names[c]).alias(c) if c in names else F.col("_rest").getField(c).alias(c) for c in docs.columns]
    return df.select(*cols, *more)


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value worked out once, however often ``then`` or its inner functions use it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.crc32(doc_id.cast("string")) % folds == fold


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")
