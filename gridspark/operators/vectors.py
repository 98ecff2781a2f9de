"""Vector quantities (VEC)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions.geo import round_half_up


def find_vector_layers(layers: DataFrame, order: str = "layer_no") -> DataFrame:
    """(dataset_id, vector_key, east_id, north_id): titles with eastward and northward paired; a repeat's last one wins."""
    title = F.col("title")
    kind = F.when(title.contains("eastward"), "eastward").when(title.contains("northward"), "northward")
    key = F.when(kind == "eastward", F.regexp_replace(title, "^(.*?)eastward_", "$1")).otherwise(F.regexp_replace(title, "^(.*?)northward_", "$1"))
    named = layers.withColumns({"kind": kind, "vector_key": key}).filter("kind is not null")
    pick = lambda k: F.max_by(F.when(F.col("kind") == k, F.col("layer_id")), F.when(F.col("kind") == k, F.col(order)))
    pairs = named.groupBy("dataset_id", "vector_key").agg(pick("eastward").alias("east_id"), pick("northward").alias("north_id"))
    return pairs.filter("east_id is not null and north_id is not null")


def components(cells: DataFrame, east: str, north: str) -> DataFrame:
    """(t, z_index, j, i, east, north) in one pass over the cells, where either component has a row."""
    both = cells.filter(F.col("layer_id").isin(east, north)).groupBy("t", "z_index", "j", "i")
    return both.agg(F.max(F.when(F.col("layer_id") == east, F.col("value"))).alias("east"), F.max(F.when(F.col("layer_id") == north, F.col("value"))).alias("north"))


def with_vectors(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """cells and, for every vector layer of pairs (layer_id, east_id, north_id), its magnitude as cells of its own.

    So every operator on scalar layers takes vector layers too: the nearest cell of a position is the same for both
    components.  Either component missing makes the magnitude null.  One pass over the components' cells.
    """
    sides = pairs.select(F.col("layer_id").alias("_vector"), F.explode(F.array(F.struct(F.col("east_id").alias("id"), F.lit(True).alias("east")), F.struct(F.col("north_id").alias("id"), F.lit(False).alias("east")))).alias("_side"))
    dealt = cells.join(sides, F.col("layer_id") == F.col("_side.id")).groupBy("_vector", "t", "z_index", "j", "i")
    both = dealt.agg(F.max(F.when(F.col("_side.east"), F.col("value"))).alias("east"), F.max(F.when(~F.col("_side.east"), F.col("value"))).alias("north"))
    own = magnitude(both).select(F.col("_vector").alias("layer_id"), "t", "z_index", "j", "i", "value")
    return cells.select(own.columns).unionByName(own)


def magnitude(df: DataFrame, east: str = "east", north: str = "north") -> DataFrame:
    """df with value = sqrt(east^2 + north^2), null if either is null."""
    return df.withColumn("value", F.sqrt(F.col(east) * F.col(east) + F.col(north) * F.col(north)))


def direction_arrows(frames: DataFrame, length: int = 10) -> DataFrame:
    """(..., px, py, angle, end_x, end_y): an arrow for every ceil(1.2 * length)-th image pixel with both components.

    frames: (px, py, east, north, ...), py from the top; arrows end in screen coordinates, which go down.
    """
    step = math.ceil(1.2 * length)
    kept = frames.filter((F.col("px") % step == 0) & (F.col("py") % step == 0) & F.col("east").isNotNull() & F.col("north").isNotNull())
    angle = F.atan2("north", "east")
    return kept.withColumns({"angle": angle, "end_x": round_half_up(F.col("px") + F.cos(angle) * length).cast("int"), "end_y": round_half_up(F.col("py") - F.sin(angle) * length).cast("int")})


def combine_layers(scalar: DataFrame, vector: DataFrame) -> DataFrame:
    """The catalogue of scalar layers followed by vector layers, with a kind column."""
    named = vector.select("dataset_id", F.concat(F.lit("vector_"), F.col("vector_key")).alias("layer_id"), F.col("vector_key").alias("title"), "east_id", "north_id", F.lit("vector").alias("kind"))
    return scalar.withColumn("kind", F.lit("scalar")).unionByName(named, allowMissingColumns=True)
