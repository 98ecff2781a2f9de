"""Gapless numbering without a window over a whole shard or source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_within(df: DataFrame, keys: list[str], order: list[Column], spread: Column, pieces: int, name: str) -> DataFrame:
    """df with a column that counts the rows of each key from 0.

    A key's rows are dealt into ``pieces`` by ``spread``, numbered there, and shifted by the rows of the pieces before;
    so a key that holds most rows is numbered by many tasks.  The order within a piece is ``order``.
    """
    dealt = df.withColumn("_piece", F.pmod(spread, F.lit(pieces)).cast("int"))
    sizes = dealt.groupBy(*keys, "_piece").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_piece").alias("_p"), F.coalesce("_before", F.lit(0)).alias("_before"))
    ranked = dealt.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy(*order)))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    on = F.col("_piece") == F.col("_p")
    for s in same:
        on = on & s
    return ranked.join(before, on).withColumn(name, (F.col("_before") + F.col("_rn") - 1).cast("long")).drop("_piece", "_p", "_before", "_rn", *[f"_k{i}" for i in range(len(keys))])
