"""Regridding and extraction (EXT): maps, series, profiles, transects, sections, tiles.

A map never builds width x height tables per layer: columns and rows are indexed as two short tables and joined to the
cells; missing pixels come back with one left join where they are wanted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions import geo
from gridspark.operators import coords, vectors

CELL = ["layer_id", "t", "z_index", "j", "i"]


def axis_index(axes: DataFrame, positions: DataFrame, axis: str, out: str) -> DataFrame:
    """positions (source_id, coord, ...) with the index of the source axis's cell, outside ones dropped."""
    a = axes.filter(F.col("axis") == axis).select(F.col("grid_id").alias("source_id"), "first", "spacing", "size", "is_longitude")
    found = positions.join(a, "source_id").withColumn(out, geo.regular_index(F.col("coord"), F.col("first"), F.col("spacing"), F.col("size"), F.col("is_longitude")))
    return found.filter(F.col(out).isNotNull()).drop("first", "spacing", "size", "is_longitude")


def pixel_axes(boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The columns (grid_id, source_id, col, coord) and rows (grid_id, source_id, row, coord) of boxes."""
    def side(n: str, low: str, high: str, name: str) -> DataFrame:
        k = boxes.withColumn(name, F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
        return k.select("grid_id", "source_id", name, F.col("width"), (F.col(low) + (F.col(name) + 0.5) * ((F.col(high) - F.col(low)) / F.col(n))).alias("coord"))

    return side("width", "min_x", "max_x", "col"), side("height", "min_y", "max_y", "row").filter(F.abs("coord") <= 90)


def pixel_map(axes: DataFrame, boxes: DataFrame) -> DataFrame:
    """(grid_id, source_id, pixel, col, row, i, j): the source cell of every pixel of boxes that has one.

    boxes: (grid_id, source_id, min_x, min_y, max_x, max_y, width, height).  Rows beyond the poles have no cell.
    """
    cols, rows = pixel_axes(boxes)
    i, j = axis_index(axes, cols, "x", "i").drop("coord"), axis_index(axes, rows, "y", "j").drop("coord", "width")
    out = i.join(j, ["grid_id", "source_id"])
    return out.select("grid_id", "source_id", (F.col("row").cast("long") * F.col("width") + F.col("col")).alias("pixel"), "col", "row", "i", "j")


def point_map(axes: DataFrame, points: DataFrame, crs: str = "CRS:84", grid_crs: str = "CRS:84") -> DataFrame:
    """points (grid_id, x, y, ...) with i and j of their source cells, null outside the grid."""
    if crs == grid_crs:
        return coords.nearest_index_regular(points, axes)
    kept = points.withColumns({"_px": F.col("x"), "_py": F.col("y")})
    found = coords.nearest_index_regular(coords.transform_crs(kept, crs, grid_crs), axes)
    return found.withColumns({"x": F.col("_px"), "y": F.col("_py")}).drop("_px", "_py")


def group_by_source_cell(pixels: DataFrame) -> DataFrame:
    """(grid_id, j, i, pixels): one row per source cell with its pixels ascending."""
    return pixels.groupBy("grid_id", "j", "i").agg(F.sort_array(F.collect_list("pixel")).alias("pixels"))


def pixel_map_stats(pixels: DataFrame) -> DataFrame:
    """(grid_id, cells, min_i, max_i, min_j, max_j, box_size) of pixel maps that aren't empty."""
    out = pixels.groupBy("grid_id").agg(F.count_distinct("i", "j").alias("cells"), F.min("i").alias("min_i"), F.max("i").alias("max_i"), F.min("j").alias("min_j"), F.max("j").alias("max_j"))
    return out.withColumn("box_size", (F.col("max_i") - F.col("min_i") + 1).cast("long") * (F.col("max_j") - F.col("min_j") + 1))


def read_horizontal(cells: DataFrame, mapped: DataFrame, keys: tuple[str, ...] = ("layer_id", "t", "z_index"), pairs: DataFrame | None = None) -> DataFrame:
    """mapped (layer_id, t, z_index, j, i, ...) with value: null where the cell is missing or outside.

    pairs: (layer_id, east_id, north_id) of vector layers, whose value is the magnitude.  Both components are read at the
    wanted cells and nowhere else: a scalar layer is its own first component and has no second.
    """
    own = cells.select(*CELL, "value")
    if pairs is None:
        return mapped.join(own, [*keys, "j", "i"], "left")
    names = pairs.select("layer_id", F.col("east_id").alias("_first"), F.col("north_id").alias("_second"))
    wanted = mapped.join(names, "layer_id", "left").withColumn("_first", F.coalesce("_first", "layer_id"))
    place = [*[k for k in keys if k != "layer_id"], "j", "i"]
    for side in ("_first", "_second"):
        wanted = wanted.join(own.select(F.col("layer_id").alias(side), *place, F.col("value").alias(side + "_value")), [side, *place], "left")
    both = vectors.magnitude(wanted, "_first_value", "_second_value")
    value = F.when(F.col("_second").isNull(), F.col("_first_value")).otherwise(F.col("value"))
    return both.withColumn("value", value).select(*mapped.columns, "value")


LAYERS = 64  # layers named in a filter


def within_box(cells: DataFrame, mapped: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """cells (layer_id, t, z_index, j, i, ...) without those outside the box of what is wanted, as a filter of the scan.

    mapped: (layer_id, t, z_index, j, i, ...); pairs: vector layers, whose components are wanted then.  The least and
    greatest t, z_index, j and i, and the layers if they are few, come from one short job over ``mapped`` and are literals
    of the plan, so that files and row groups of cells that are stored in the order of write_cells are skipped.
    """
    axes = [c for c in ("t", "z_index", "j", "i") if c in mapped.columns]
    if pairs is not None:
        names = pairs.select("layer_id", F.explode(F.array("east_id", "north_id")).alias("_part"))
        mapped = mapped.join(names, "layer_id", "left").withColumn("layer_id", F.coalesce("_part", "layer_id"))
    few = mapped.select("layer_id").distinct().limit(LAYERS + 1)
    span = mapped.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in axes for f in (F.min, F.max)]).first()
    layers = [r.layer_id for r in few.collect()]
    inside = F.lit(True) if len(layers) > LAYERS else F.col("layer_id").isin(layers)
    for c in axes:
        if span[f"min_{c}"] is None:
            return cells.filter(F.lit(False))
        inside = inside & (F.col(c) >= F.lit(span[f"min_{c}"])) & (F.col(c) <= F.lit(span[f"max_{c}"]))
    return cells.filter(inside)


def read_single_points(cells: DataFrame, axes: DataFrame, requests: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """requests (layer_id, t, z_index, grid_id, x, y, ...) with i, j and value; pairs as in read_horizontal."""
    return read_horizontal(cells, point_map(axes, requests), pairs=pairs)


def read_timeseries(cells: DataFrame, steps: DataFrame, axes: DataFrame, requests: DataFrame, pairs: DataFrame | None = None, bucket: int = 512) -> DataFrame:
    """(request_id, t, value) for every step of a request's layer; null where missing.

    requests: (request_id, layer_id, z_index, grid_id, x, y); pairs as in read_horizontal.  Requests of one cell share its
    series, so a popular cell is read once.  A series is kept in pieces of ``bucket`` steps, and requests of a cell meet its
    pieces one by one, so that neither a long axis nor a popular cell is one row.
    """
    found = point_map(axes, requests)
    place = ["layer_id", "z_index", "j", "i"]
    wanted = found.filter("i is not null and j is not null").select(*place).distinct()
    order = Window.partitionBy("layer_id").orderBy("t")
    dealt = steps.select("layer_id", "t").withColumn("part", F.floor((F.row_number().over(order) - 1) / bucket).cast("int"))
    read = read_horizontal(cells, wanted.join(dealt, "layer_id"), pairs=pairs)
    series = read.groupBy(*place, "part").agg(F.collect_list(F.struct("t", "value")).alias("series"))
    inside = found.join(series, place).select("request_id", F.explode("series").alias("s")).select("request_id", "s.t", "s.value")
    outside = found.filter("i is null or j is null").join(steps.select("layer_id", "t"), "layer_id").select("request_id", "t", F.lit(None).cast("double").alias("value"))
    return inside.unionByName(outside)


def vertical_profile(cells: DataFrame, z_axis: DataFrame, axes: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, z_index, z, value) at every elevation that has a value.  requests: (request_id, layer_id, t, grid_id, x, y)."""
    found = point_map(axes, requests)
    values = found.join(cells.select(*CELL, "value").filter("value is not null"), ["layer_id", "t", "j", "i"])
    return values.join(z_axis.select("layer_id", "z_index", "z"), ["layer_id", "z_index"]).select("request_id", "z_index", "z", "value")


def points_on_path(control: DataFrame, n: Column | int) -> DataFrame:
    """(line_id, n, k, x, y): n points at equal distances along lines of control points; ends are the control points.

    control: (line_id, seq, x, y, distance, and columns that n is made of).  A point belongs to the segment that begins at or before it.
    """
    along = Window.partitionBy("line_id").orderBy("seq")
    nxt = {c: F.lead(c).over(along) for c in ("x", "y", "distance", "seq")}
    whole = F.max("distance").over(Window.partitionBy("line_id"))
    segments = control.select("line_id", "seq", "x", "y", "distance", *[c.alias("next_" + k) for k, c in nxt.items()], whole.alias("whole"), (n if isinstance(n, Column) else F.lit(n)).alias("n"))
    segments = segments.filter(F.col("next_seq").isNotNull())
    last = F.col("next_seq") == F.max("next_seq").over(Window.partitionBy("line_id"))
    segments = segments.withColumn("last", last)
    segments = segments.withColumn("n", F.explode("n")) if dict(segments.dtypes)["n"].startswith("array") else segments
    # the points of a segment follow from its distances: only they are made
    step = F.col("whole") / (F.col("n") - 1)
    low = F.when(step > 0, F.ceil(F.col("distance") / step)).otherwise(0)
    high = F.when(F.col("last"), F.col("n") - 1).otherwise(F.when(step > 0, F.ceil(F.col("next_distance") / step) - 1).otherwise(-1))
    made = segments.withColumn("step", step).withColumn("low", low.cast("int")).withColumn("high", high.cast("int")).filter("low <= high")
    made = made.withColumn("k", F.explode(F.sequence("low", "high")))
    share = F.when((F.col("k") == F.col("n") - 1) | (F.col("next_distance") <= F.col("distance")), 1.0).otherwise((F.col("k") * F.col("step") - F.col("distance")) / (F.col("next_distance") - F.col("distance")))
    share = F.when(F.col("k") == 0, 0.0).otherwise(share)
    return made.select("line_id", "n", "k", (F.col("x") + share * (F.col("next_x") - F.col("x"))).alias("x"), (F.col("y") + share * (F.col("next_y") - F.col("y"))).alias("y"))


def distinct_cells_sampled(mapped: DataFrame, keys: tuple[str, ...], approximate: bool = False) -> DataFrame:
    """(keys, cells): distinct source cells of a point set; all points outside the grid count as one more."""
    cell = F.struct("i", "j")
    inside = F.col("i").isNotNull() & F.col("j").isNotNull()
    count = F.approx_count_distinct if approximate else F.count_distinct
    return mapped.groupBy(*keys).agg((count(F.when(inside, cell)) + F.max(F.when(inside, 0).otherwise(1))).cast("long").alias("cells"))


def optimal_transect(control: DataFrame, axes: DataFrame, grid_id: str, step: int = 500, most: int = 5000, growth: float = 1.1) -> DataFrame:
    """(line_id, n, k, x, y): points of the last resolution before the distinct cells grow by a tenth or less.

    Resolutions step, 2 * step, ... up to most are counted in one pass; a line that still grows at most keeps most.  Points are
    made again for the chosen resolution alone.
    """
    # points are many times the bytes that Spark takes them for: lines are dealt to a fixed number of tasks, unlike a shuffle's
    # own, so that Spark neither drops this step nor puts few bytes together in one task; both sides stay there, not broadcast
    control = control.repartition(2 * int(control.sparkSession.conf.get("spark.sql.shuffle.partitions")), "line_id")
    tried = points_on_path(control, F.array(*[F.lit(n) for n in range(step, most + 1, step)]))
    counts = distinct_cells_sampled(point_map(axes, tried.withColumn("grid_id", F.lit(grid_id))), ("line_id", "n"))
    before = F.lag("cells").over(Window.partitionBy("line_id").orderBy("n"))
    flat = F.when(F.col("cells") <= F.col("before") * growth, F.col("n"))
    chosen = counts.withColumn("before", before).groupBy("line_id").agg(F.coalesce(F.min(flat) - step, F.lit(most)).alias("n"))
    kept = control.join(chosen.hint("merge"), "line_id")
    return points_on_path(kept, F.col("n"))


def transect(cells: DataFrame, axes: DataFrame, points: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """points (line_id, k, grid_id, x, y, layer_id, t, z_index) with value.

    pairs: (layer_id, east_id, north_id) of vector layers, whose value is the magnitude.
    """
    return read_single_points(cells, axes, points, pairs)


def vertical_section(cells: DataFrame, z_axis: DataFrame, axes: DataFrame, points: DataFrame) -> DataFrame:
    """(line_id, k, z_index, z, value) at all elevations of the layer; elevations without any value on the line are dropped.

    points: (line_id, k, grid_id, x, y, layer_id, t).
    """
    levels = z_axis.select("layer_id", "z_index", "z")
    read = read_horizontal(cells, point_map(axes, points).join(levels, "layer_id"))
    filled = read.withColumn("filled", F.count("value").over(Window.partitionBy("line_id", "layer_id", "t", "z_index")))
    return filled.filter("filled > 0").select("line_id", "layer_id", "t", "k", "z_index", "z", "value")


def resample_section(section: DataFrame, n: int = 300) -> DataFrame:
    """(line_id, h, height, k, value): n even heights; each takes the nearest level, the first in the list on a tie."""
    levels = section.select("line_id", "z_index", "z").distinct()
    span = levels.groupBy("line_id").agg(F.min("z").alias("low"), F.max("z").alias("high"))
    heights = span.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("line_id", "h", (F.col("low") + F.col("h") * ((F.col("high") - F.col("low")) / max(1, n - 1))).alias("height"))
    near = heights.join(levels, "line_id").groupBy("line_id", "h", "height").agg(F.min_by("z_index", F.struct(F.abs(F.col("z") - F.col("height")), "z_index")).alias("z_index"))
    return near.join(section.select("line_id", "z_index", "k", "value"), ["line_id", "z_index"]).select("line_id", "h", "height", "k", "value")


def feature_info(cells: DataFrame, steps: DataFrame, axes: DataFrame, clicks: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(request_id, lon, lat, i, j, cell_x, cell_y, series): clicks on images with the cell and its (t, value) series.

    clicks: (request_id, layer_id, z_index, grid_id, px, py, min_x, min_y, max_x, max_y, width, height); pairs: (layer_id,
    east_id, north_id) of vector layers, whose series is the magnitude.  steps has a layer's times, a vector layer's too.
    """
    placed = coords.pixel_to_position(clicks).filter("error is null")
    found = point_map(axes, placed).select("request_id", F.col("x").alias("lon"), F.col("y").alias("lat"), "i", "j", "grid_id")
    centre = lambda axis, k: axes.filter(F.col("axis") == axis).select("grid_id", F.col("first").alias("_f" + k), F.col("spacing").alias("_s" + k))
    found = found.join(centre("x", "x"), "grid_id").join(centre("y", "y"), "grid_id")
    found = found.withColumn("cell_x", F.col("_fx") + F.col("i") * F.col("_sx")).withColumn("cell_y", F.col("_fy") + F.col("j") * F.col("_sy"))
    series = read_timeseries(cells, steps, axes, placed, pairs).groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("t", "value"))).alias("series"))
    return found.join(series, "request_id", "left").select("request_id", "lon", "lat", "i", "j", "cell_x", "cell_y", "series")


def map_frames(cells: DataFrame, axes: DataFrame, boxes: DataFrame, frames: DataFrame) -> DataFrame:
    """(grid_id, layer_id, t, z_index, pixel, col, row, value, label): a frame of pixels for each time.

    frames: (grid_id, layer_id, t, z_index).  Pixels without a cell have no row; label is null where there is one frame.
    """
    pixels = pixel_map(axes, boxes).drop("source_id")
    read = read_horizontal(cells, pixels.join(frames, "grid_id"))
    counted = frames.groupBy("grid_id", "layer_id", "z_index").agg(F.count("*").alias("n"))
    return read.join(counted, ["grid_id", "layer_id", "z_index"]).select("grid_id", "layer_id", "t", "z_index", "pixel", "col", "row", "value", F.when(F.col("n") > 1, F.date_format("t", "yyyy-MM-dd")).alias("label"))


def tile_grid(layers: DataFrame, zooms: tuple[int, ...]) -> DataFrame:
    """layers with zoom, tile_row, tile_col and the tile's box: 2^(z-1) rows of 2^z square tiles, rows from the south."""
    zoom = layers.withColumn("zoom", F.explode(F.array(*map(F.lit, zooms)))).withColumn("span", F.lit(360.0) / F.pow(F.lit(2.0), "zoom"))
    tiles = zoom.withColumn("tile_row", F.explode(F.sequence(F.lit(0), F.pow(F.lit(2.0), F.col("zoom") - 1).cast("int") - 1)))
    tiles = tiles.withColumn("tile_col", F.explode(F.sequence(F.lit(0), F.pow(F.lit(2.0), "zoom").cast("int") - 1)))
    low_x, low_y = F.col("tile_col") * F.col("span") - 180, F.col("tile_row") * F.col("span") - 90
    return tiles.withColumns({"min_x": low_x, "min_y": low_y, "max_x": low_x + F.col("span"), "max_y": low_y + F.col("span")}).drop("span")


def tile_pyramid(cells: DataFrame, axes: DataFrame, grid_id: str, zooms: tuple[int, ...], size: int = 256) -> DataFrame:
    """(layer_id, t, z_index, zoom, tile_row, tile_col, px, py, value): the pixels of every tile that have a value.

    A zoom level's pixels are separable: size * 2^zoom columns and half as many rows are indexed on their own, and the
    cells are joined to both, so that a cell only meets the pixels that show it.
    """
    one = axes.filter((F.col("grid_id") == grid_id) & (F.col("axis") == "x")).select(F.col("grid_id").alias("source_id"))

    def side(axis: str, out: str, tile: str, pixel: str, offset: float) -> DataFrame:
        zoom = one.withColumn("zoom", F.explode(F.array(*map(F.lit, zooms))))
        count = (F.pow(F.lit(2.0), F.col("zoom") - (1 if axis == "y" else 0)) * size).cast("int")
        k = zoom.withColumn("k", F.explode(F.sequence(F.lit(0), count - 1)))
        coord = (F.col("k") + 0.5) * (F.lit(360.0) / (F.pow(F.lit(2.0), "zoom") * size)) + offset
        found = axis_index(axes, k.withColumn("coord", coord), axis, out)
        return found.select("zoom", out, F.floor(F.col("k") / size).cast("int").alias(tile), (F.col("k") % size).cast("int").alias(pixel))

    cols = side("x", "i", "tile_col", "px", -180.0).groupBy("zoom", "i").agg(F.collect_list(F.struct("tile_col", "px")).alias("cols"))
    rows = side("y", "j", "tile_row", "py", -90.0).groupBy("zoom", "j").agg(F.collect_list(F.struct("tile_row", "py")).alias("rows"))
    out = cells.filter("value is not null").join(cols, "i").join(rows, ["j", "zoom"])
    out = out.select("layer_id", "t", "z_index", "zoom", "value", F.explode("cols").alias("c"), "rows").select("layer_id", "t", "z_index", "zoom", "value", "c", F.explode("rows").alias("r"))
    return out.select("layer_id", "t", "z_index", "zoom", "r.tile_row", "c.tile_col", "c.px", "r.py", "value")


def multi_series(series: dict[str, DataFrame], axis: str = "t") -> DataFrame:
    """(label, axis, value, low, high): labelled series one under the other, with the range over all of them."""
    labelled = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("label"), axis, "value") for name, df in series.items()])
    span = labelled.agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return labelled.join(F.broadcast(span))  # one row


def transect_segments(control: DataFrame, n: int) -> DataFrame:
    """(line_id, seq, start, end): where each segment of a line begins and ends among n points."""
    nxt = F.lead("fraction").over(Window.partitionBy("line_id").orderBy("seq"))
    return control.withColumn("next", nxt).filter("next is not null").select("line_id", "seq", (F.col("fraction") * n).alias("start"), (F.col("next") * n).alias("end"))
