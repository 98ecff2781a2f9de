"""Reading grids and writing results (SRC, SNK)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.geo import POLAR_SIZE
from gridspark.operators.tiles import morton

CELLS = "layer_id string, t timestamp, z_index int, j int, i int, value double"

_readers: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register_reader(name: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    """Make a reader known under a name: a function of a session and a path pattern that returns cells."""
    _readers[name] = reader


def read_with(name: str, spark: SparkSession, glob: str) -> DataFrame:
    if name not in _readers:
        raise ValueError(f"no reader is called {name}")
    return _readers[name](spark, glob)


def read_cells(spark: SparkSession, glob: str, format: str = "parquet", **options: str) -> DataFrame:
    """The files of an absolute path with wildcards as one dataset, with the file's path in source_file.

    A relative path is an error, and so is a pattern that nothing matches.
    """
    if not (glob.startswith("/") or "://" in glob):
        raise ValueError(f"an absolute path is wanted: {glob}")
    return spark.read.options(**options).format(format).load(glob).withColumn("source_file", F.col("_metadata.file_path"))


def decode_packed(df: DataFrame, raw: str = "raw", scale: str = "scale", offset: str = "offset", missing: str = "missing") -> DataFrame:
    """df with value = raw * scale + offset; the missing marker and NaN become null."""
    r = F.col(raw).cast("double")
    gone = F.col(raw).eqNullSafe(F.col(missing)) | F.isnan(r)
    return df.withColumn("value", F.when(~gone, r * F.col(scale) + F.col(offset)))


def time_from_filename(df: DataFrame, pattern: str, form: str, path: str = "source_file") -> DataFrame:
    """df with t from the first group of a pattern in the file's name, and an error where there is no date."""
    name = F.regexp_extract(F.col(path), r"([^/]*)$", 1)
    t = F.try_to_timestamp(F.regexp_extract(name, pattern, 1), F.lit(form))
    return df.withColumn("t", t).withColumn("error", F.when(t.isNull(), F.concat(F.lit("no date in "), name)))


#: The two kinds of file names that carry dates: pattern and form.
POLAR_NAME = (r"^NL(\d{6})\.v01\.NSIDC8$", "yyyyMM")
DAILY_NAME = (r"_(\d{8})\.nc$", "yyyyMMdd")


def mask_nonpositive(df: DataFrame, value: str = "value") -> DataFrame:
    return df.withColumn(value, F.when(F.col(value) > 0, F.col(value)))


def _decode_rasters(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for name, content in zip(frame["source_file"], frame["content"], strict=True):
            if len(content) != 2 * POLAR_SIZE * POLAR_SIZE:
                raise ValueError(f"{name} has {len(content)} bytes, where a raster of {POLAR_SIZE} x {POLAR_SIZE} has {2 * POLAR_SIZE * POLAR_SIZE}")
            raster = np.frombuffer(content, "<i2")
            at = np.flatnonzero(raster > 0)
            for part in np.array_split(at, max(1, len(at) // 65536)):
                yield pd.DataFrame({"source_file": name, "j": (part // POLAR_SIZE).astype(np.int32), "i": (part % POLAR_SIZE).astype(np.int32), "value": raster[part].astype(float)})


def read_polar_binary(spark: SparkSession, glob: str, layer_id: str = "swe") -> DataFrame:
    """cells of monthly little-endian int16 rasters of 721 x 721; values of 0 or less are missing.

    A file of any other size is an error.  The month is in the file's name; files without one are left out (time_from_filename names them).
    """
    files = spark.read.format("binaryFile").load(glob).select(F.col("path").alias("source_file"), "content")
    cells = files.mapInPandas(_decode_rasters, "source_file string, j int, i int, value double")
    dated = time_from_filename(cells, *POLAR_NAME).filter("error is null")
    return dated.select(F.lit(layer_id).alias("layer_id"), "t", F.lit(0).alias("z_index"), "j", "i", "value")


register_reader("polar", read_polar_binary)
register_reader("parquet", read_cells)


def write_usage_csv(log: DataFrame, path: str) -> None:
    """The whole log as CSV with a header, instants to the microsecond."""
    whole = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    log.write.mode("overwrite").options(header=True, timestampFormat=whole + "XXX", timestampNTZFormat=whole).csv(path)


def feature_info_rows(info: DataFrame) -> DataFrame:
    """Feature info ready to write: missing values are the word none."""
    text = F.transform("series", lambda s: F.struct(s["t"].cast("string").alias("time"), F.coalesce(s["value"].cast("string"), F.lit("none")).alias("value")))
    return info.withColumn("series", text)


def write_feature_info(info: DataFrame, path: str, format: str = "json") -> None:
    """(request_id, lon, lat, i, j, cell_x, cell_y, series) as json or xml, one record per point."""
    writer = feature_info_rows(info).write.mode("overwrite").format(format)
    (writer.option("rowTag", "FeatureInfo").option("rootTag", "FeatureInfoResponse") if format == "xml" else writer).save(path)


def transect_rows(points: DataFrame, keys: list[str]) -> DataFrame:
    """One record per transect with its points (x, y, value) in order and their count; a transect has some thousand points."""
    listed = points.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", "x", "y", F.coalesce(F.col("value").cast("string"), F.lit("none")).alias("value")))).alias("points"))
    return listed.withColumn("count", F.size("points"))


def write_transect(points: DataFrame, path: str, keys: list[str], format: str = "json") -> None:
    writer = transect_rows(points, keys).write.mode("overwrite").format(format)
    (writer.option("rowTag", "transect").option("rootTag", "transects") if format == "xml" else writer).save(path)


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Tile pixels in folders by layer and zoom; a tile is in one file, and so are most of its neighbours.

    Tiles are dealt in ranges along a curve through rows and columns, so that a region of tiles is read from few files.
    """
    order = ["layer_id", "zoom", "_place"]
    dealt = tiles.withColumn("_place", morton(F.col("tile_col"), F.col("tile_row"))).repartitionByRange(*order).sortWithinPartitions(*order, "t", "z_index")
    dealt.drop("_place").write.mode("overwrite").partitionBy("layer_id", "zoom").parquet(path)


def write_tile_index(index: DataFrame, path: str) -> None:
    """A tile index of curvilinear cells as parquet, a folder for each grid and level, neighbouring tiles together.

    Sixteen tile rows of a grid are in one file, so that a grid is spread over tasks and a lookup in a region reads a few.
    """
    dealt = index.repartition("grid_id", "level", F.floor(F.col("ty") / 16))
    dealt.sortWithinPartitions("grid_id", "level", "ty", "tx").write.mode("overwrite").partitionBy("grid_id", "level").parquet(path)


def write_cells(cells: DataFrame, path: str) -> None:
    """Cells (layer_id, t, z_index, j, i, value) as parquet, a folder for each layer, neighbours in time, level and place together.

    So a reader that asks for a box (see extract.within_box) skips what lies outside it.
    """
    order = ["layer_id", "t", "z_index", "j", "i"]
    cells.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("layer_id").parquet(path)
