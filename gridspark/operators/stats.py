"""Ranges, reports and usage counts (AGG)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.operators import extract

DIMENSIONS = ("client_hostname", "client_user_agent", "client_referrer")


def find_min_max(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, vmin, vmax) ignoring nulls; both null if there is no value."""
    return df.groupBy(*keys).agg(F.min(value).alias("vmin"), F.max(value).alias("vmax"))


def min_max_for_view(cells: DataFrame, axes: DataFrame, requests: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(grid_id, vmin, vmax) over the pixels of map requests, one box, layer, time and elevation each.

    pairs: (layer_id, east_id, north_id) of vector layers, whose range is that of the magnitude.
    """
    pixels = extract.pixel_map(axes, requests).drop("source_id")
    read = extract.read_horizontal(cells, pixels.join(requests.select("grid_id", "layer_id", "t", "z_index"), "grid_id"), pairs=pairs)
    found = find_min_max(read, ["grid_id"])
    return requests.select("grid_id").join(found, "grid_id", "left")


def estimate_value_range(cells: DataFrame, axes: DataFrame, layers: DataFrame, size: int = 100, pairs: DataFrame | None = None) -> DataFrame:
    """(layer_id, vmin, vmax) of a size x size sample of each layer's box at its default time and elevation, in one job.

    layers: (layer_id, source_id, t, z_index, min_x, min_y, max_x, max_y); pairs: (layer_id, east_id, north_id) of vector
    layers, whose range is that of the magnitude of both components.
    """
    boxes = layers.withColumns({"grid_id": F.col("layer_id"), "width": F.lit(size), "height": F.lit(size)})
    hit = extract.pixel_map(axes, boxes).select(F.col("grid_id").alias("layer_id"), "i", "j").distinct()
    read = extract.read_horizontal(cells, hit.join(layers.select("layer_id", "t", "z_index"), "layer_id"), pairs=pairs)
    return layers.select("layer_id").join(find_min_max(read, ["layer_id"]), "layer_id", "left")


def default_colour_range(df: DataFrame) -> DataFrame:
    """Ranges (vmin, vmax) made drawable: -50 to 50 if empty, one wider if flat, else 5 % wider on both sides."""
    low, high = F.col("vmin"), F.col("vmax")
    span = high - low
    return df.withColumns({
        "vmin": F.when(low.isNull(), -50.0).when(low == high, low).otherwise(low - span * 0.05),
        "vmax": F.when(low.isNull(), 50.0).when(low == high, high + 1).otherwise(high + span * 0.05)})


def auto_scale(frames: DataFrame, keys: list[str], value: str = "value", component: str | None = None) -> DataFrame:
    """frames with the common range of all frames of an animation.

    component, for frames with east and north: "x" is the range of the eastward component alone, "magnitude" that of the
    length.
    """
    if component:
        wanted = {"x": F.col("east"), "magnitude": F.sqrt(F.col("east") * F.col("east") + F.col("north") * F.col("north"))}[component]
        return auto_scale(frames.withColumn("_scaled", wanted), keys, "_scaled").drop("_scaled")
    found = find_min_max(frames, keys, value).withColumnsRenamed({k: "_" + k for k in keys})
    same = [F.col(k).eqNullSafe(F.col("_" + k)) for k in keys]
    return frames.join(found, same).drop(*["_" + k for k in keys])


def section_range(section: DataFrame) -> DataFrame:
    return find_min_max(section, ["line_id"])


def layer_report(cells: DataFrame, layers: DataFrame, axes: DataFrame, size: int = 256) -> DataFrame:
    """(layer_id, title, units, min_x, min_y, max_x, max_y, times, elevations, vmin, vmax): a row per layer with cells.

    The axes' sizes and the range of a sample at the first time and elevation.  layers: (layer_id, title, units,
    source_id, min_x, min_y, max_x, max_y).
    """
    found = cells.groupBy("layer_id").agg(F.count_distinct("t").alias("times"), F.count_distinct("z_index").alias("elevations"), F.min("t").alias("t"), F.min("z_index").alias("z_index"))
    sample = estimate_value_range(cells, axes, layers.join(found.select("layer_id", "t", "z_index"), "layer_id"), size)
    named = layers.select("layer_id", "title", "units", "min_x", "min_y", "max_x", "max_y")
    return named.join(found.select("layer_id", "times", "elevations"), "layer_id").join(sample, "layer_id")


def _is_map() -> Column:
    return F.col("wms_operation") == "GetMap"


def usage_by(log: DataFrame, dim: str) -> DataFrame:
    """(dim, requests, cached, percent) of map requests; the order is by requests, then name: see rank."""
    out = log.filter(_is_map()).groupBy(dim).agg(F.count("*").alias("requests"), F.count_if("used_cache").alias("cached"))
    return out.withColumn("percent", F.col("cached") * 100.0 / F.col("requests")).orderBy(F.desc("requests"), dim)


def usage_totals(log: DataFrame) -> DataFrame:
    """(client_hostname, client_user_agent, client_referrer, dimension, requests, cached): all reports and the total.

    dimension names the column a row is for; a null in that column is a value of the log, ``total`` has them all null.
    """
    host, agent, referrer = DIMENSIONS
    sets = log.filter(_is_map()).groupingSets([[host], [agent], [referrer], []], host, agent, referrer)
    which = F.when(F.grouping(host) == 0, host).when(F.grouping(agent) == 0, agent).when(F.grouping(referrer) == 0, referrer).otherwise("total")
    return sets.agg(which.alias("dimension"), F.count("*").alias("requests"), F.count_if("used_cache").alias("cached"))


def usage_entry_count(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("entries"))


def find_duplicate_ids(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): ids that are used more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def ranked(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """df with rank within the keys."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
