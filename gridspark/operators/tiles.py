"""Tiles of several sizes: at level n the globe is 2^n tiles wide.

A box belongs to the level whose tiles are as large as it or larger, so that it touches at most two by two of them.
Whatever a box may meet stands in its own tiles or, if it is larger, in a tile above them; so both sides of a join send
their boxes to the levels that the other side has, and small boxes never crowd a tile that was made for large ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINEST = 20
BOX = ("min_x", "min_y", "max_x", "max_y")


def level_of(width: Column, height: Column) -> Column:
    """The level of a box; FINEST for points and NaN."""
    size = F.greatest(width, height)
    return F.when(size > 0, F.greatest(F.lit(0), F.least(F.lit(FINEST), F.floor(F.log2(F.lit(360.0) / size)).cast("int")))).otherwise(F.lit(FINEST))


def tile(c: Column, level: Column) -> Column:
    return F.floor(c * F.pow(F.lit(2.0), level) / 360).cast("long")


def morton(x: Column, y: Column) -> Column:
    """The place of a tile along a curve that keeps neighbours together: the bits of x and y in turn, up to 2^30 tiles."""
    def spread(c: Column) -> Column:
        c = c.cast("long")
        # fixed values: shifts, and the masks of every other bit, pair, group of four ... that stay
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
        return c

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def with_level(df: DataFrame) -> DataFrame:
    """Boxes (min_x, min_y, max_x, max_y) with their own level."""
    return df.withColumn("level", level_of(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")))


def in_tiles(df: DataFrame, box: tuple[str, str, str, str] = BOX) -> DataFrame:
    """df with a row for each tile (tx, ty) of its level that its box touches."""
    run = lambda a, b: F.explode(F.sequence(tile(F.col(a), F.col("level")), tile(F.col(b), F.col("level"))))
    return df.withColumn("tx", run(box[0], box[2])).withColumn("ty", run(box[1], box[3]))


def at_levels(df: DataFrame, levels: DataFrame, keys: tuple[str, ...] = (), above: bool = False) -> DataFrame:
    """df (own level) with a row for each level up to its own that ``levels`` (keys, level) has; ``above``: but its own."""
    last = F.col("level") - 1 if above else F.col("level")
    if keys:  # the levels of a key, FINEST + 1 at most, come as one row
        there = levels.groupBy(*keys).agg(F.collect_set("level").alias("_levels"))
        return df.join(there, list(keys)).withColumn("level", F.explode(F.filter("_levels", lambda n: n <= last))).drop("_levels")
    sent = df.filter(last >= 0).withColumn("level", F.explode(F.sequence(F.lit(0), last)))
    return sent.join(levels.select("level").distinct(), "level", "left_semi")


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every pair of boxes of a (a_id) and b (b_id) that overlap or touch, once, with the intersection.

    A pair meets on the level of the larger box, and is reported in the tile that holds its intersection's lower corner.
    """
    name = lambda df, p: with_level(df).select(f"{p}_id", *[F.col(c).alias(f"{p}_{c}") for c in BOX], "level")
    a, b = name(a, "a"), name(b, "b")
    box = {p: tuple(f"{p}_{c}" for c in BOX) for p in "ab"}
    meet = ["level", "tx", "ty"]
    large_a = in_tiles(a, box["a"]).join(in_tiles(at_levels(b, a), box["b"]), meet)
    large_b = in_tiles(at_levels(a, b, above=True), box["a"]).join(in_tiles(b, box["b"]), meet)
    low = {c: F.greatest(f"a_{c}", f"b_{c}") for c in ("min_x", "min_y")}
    high = {c: F.least(f"a_{c}", f"b_{c}") for c in ("max_x", "max_y")}
    pairs = large_a.unionByName(large_b).select(*meet, "a_id", "b_id", *[v.alias(k) for k, v in (low | high).items()])
    home = (tile(F.col("min_x"), F.col("level")) == F.col("tx")) & (tile(F.col("min_y"), F.col("level")) == F.col("ty"))
    return pairs.filter((F.col("min_x") <= F.col("max_x")) & (F.col("min_y") <= F.col("max_y")) & home).drop(*meet)
