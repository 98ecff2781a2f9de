"""Elevation axes (ELV)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Units that make an elevation axis a pressure axis.
PRESSURE_UNITS = ("Pa", "hPa", "bar", "millibar", "decibar", "atmosphere", "atm", "pascal")


def normalise_elevation(z_axis: DataFrame) -> DataFrame:
    """Values negated unless the axis is positive upwards or a pressure axis."""
    return z_axis.withColumn("z", F.when(F.col("positive") | F.col("pressure"), F.col("z")).otherwise(-F.col("z")))


def default_elevation(z_axis: DataFrame) -> DataFrame:
    """(layer_id, z): the greatest value of a pressure axis, else the value nearest to 0, the first on ties."""
    pressure = F.first("units").isin(*PRESSURE_UNITS)
    return z_axis.groupBy("layer_id").agg(F.when(pressure, F.max("z")).otherwise(F.min_by("z", F.struct(F.abs("z"), "z_index"))).alias("z"))


def match_elevation(requests: DataFrame, z_axis: DataFrame, text: str = "elevation") -> DataFrame:
    """requests with z_index and error.

    A value matches the first level that equals it or is within a hundred-thousandth of it; a list or range is an error,
    null takes the default, a layer without axis passes with a null index.
    """
    levels = z_axis.groupBy("layer_id").agg(F.sort_array(F.collect_list(F.struct("z_index", "z"))).alias("levels"))
    both = requests.join(levels, "layer_id", "left").join(default_elevation(z_axis).withColumnRenamed("z", "default_z"), "layer_id", "left")
    wanted = F.when(F.col(text).isNull(), F.col("default_z")).otherwise(F.col(text).try_cast("double"))
    hits = F.filter("levels", lambda x: (x["z"] == F.col("wanted")) | (F.abs(F.try_divide(x["z"] - F.col("wanted"), F.col("wanted"))) < 1e-5))
    both = both.withColumn("wanted", wanted)
    both = both.withColumn("z_index", F.try_element_at(hits, F.lit(1))["z_index"])
    error = (F.when(F.col("levels").isNull(), F.lit(None).cast("string")).when(F.col(text).rlike("[,/]"), "one elevation only")
             .when(F.col(text).isNotNull() & F.col("wanted").isNull(), "not a number").when(F.col("z_index").isNull(), "no such elevation"))
    return both.withColumn("error", error).withColumn("z_index", F.when(F.col("error").isNull(), F.col("z_index"))).drop("levels", "default_z", "wanted")


def nearest_elevation(requests: DataFrame, z_axis: DataFrame, target: str = "target") -> DataFrame:
    """requests with the nearest level's z_index and z, the first on ties."""
    levels = z_axis.groupBy("layer_id").agg(F.collect_list(F.struct("z_index", "z")).alias("levels"))
    best = F.array_min(F.transform("levels", lambda x: F.struct(F.abs(x["z"] - F.col(target)).alias("d"), x["z_index"].alias("z_index"), x["z"].alias("z"))))
    return requests.join(levels, "layer_id", "left").withColumn("best", best).withColumns({"z_index": F.col("best.z_index"), "z": F.col("best.z")}).drop("levels", "best")


def display_elevation(z_axis: DataFrame) -> DataFrame:
    """z_axis with label (Height, Pressure or Depth), inverted, and display_z, which shows depths as positive."""
    label = F.when(F.col("positive"), "Height").when(F.col("pressure"), "Pressure").otherwise("Depth")
    return z_axis.withColumns({"label": label, "inverted": ~F.col("positive"), "display_z": F.when(label == "Depth", -F.col("z")).otherwise(F.col("z"))})
