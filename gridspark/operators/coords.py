"""Axes, grids, boxes and lines (GEO)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.functions import geo
from gridspark.operators import tiles


def axis_extent(axes: DataFrame) -> DataFrame:
    """(grid_id, axis, min, max) of regular axes, half a cell beyond both ends."""
    low, high = geo.regular_extent(F.col("first"), F.col("spacing"), F.col("size"))
    return axes.select("grid_id", "axis", low.alias("min"), high.alias("max"))


def irregular_extent(values: DataFrame, key: str = "axis_id") -> DataFrame:
    """(key, min, max) of irregular axes from (key, idx, coord); the end cells are as wide as the steps beside them."""
    near = F.sort_array(F.collect_list("coord"))
    ends = values.groupBy(key).agg(near.alias("v"))
    n, v = F.size("v"), F.col("v")
    low = F.element_at(v, 1) - (F.element_at(v, F.least(F.lit(2), n)) - F.element_at(v, 1)) / 2
    high = F.element_at(v, n) + (F.element_at(v, n) - F.element_at(v, F.greatest(F.lit(1), n - 1))) / 2
    return ends.select(key, low.alias("min"), high.alias("max"))


def _axis(axes: DataFrame, axis: str, prefix: str) -> DataFrame:
    return axes.filter(F.col("axis") == axis).select("grid_id", *[F.col(c).alias(prefix + c) for c in ("first", "spacing", "size", "is_longitude")])


def _on(prefix: str) -> list[Column]:
    return [F.col(prefix + c) for c in ("first", "spacing", "size", "is_longitude")]


def nearest_index_regular(points: DataFrame, axes: DataFrame) -> DataFrame:
    """points (grid_id, x, y, ...) with i and j, the cell of their grid; null outside.

    Axes are joined on grid_id: Spark broadcasts them if they are small.
    """
    both = points.join(_axis(axes, "x", "_x"), "grid_id").join(_axis(axes, "y", "_y"), "grid_id")
    out = both.withColumn("i", geo.regular_index(F.col("x"), *_on("_x"))).withColumn("j", geo.regular_index(F.col("y"), *_on("_y")))
    return out.drop(*[p + c for p in ("_x", "_y") for c in ("first", "spacing", "size", "is_longitude")])


def irregular_edges(values: DataFrame, key: str = "axis_id") -> DataFrame:
    """(key, mids, min, max, n, backwards): what a lookup on irregular axes needs, one row per axis."""
    v = F.sort_array(F.collect_list("coord"))
    rows = values.groupBy(key).agg(v.alias("v"), (F.max_by("coord", "idx") < F.min_by("coord", "idx")).alias("backwards"))
    n = F.size("v")
    mids = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda k: (F.element_at("v", k) + F.element_at("v", k + 1)) / 2)).otherwise(F.array().cast("array<double>"))
    rows = rows.withColumn("mids", mids)
    first, last = F.element_at("v", 1), F.element_at("v", n)
    low = F.when(n > 1, first - (F.element_at("mids", 1) - first)).otherwise(first)
    high = F.when(n > 1, last + (last - F.element_at("mids", -1))).otherwise(last)
    return rows.select(key, "mids", low.alias("min"), high.alias("max"), n.alias("n"), "backwards")


def nearest_index_irregular(points: DataFrame, values: DataFrame, key: str = "axis_id") -> DataFrame:
    """points (key, x, ...) with idx of the nearest axis value: the lower one at a tie, null outside the extent."""
    edges = irregular_edges(values, key)
    at = geo.count_below(F.col("mids"), F.col("x"))
    found = F.when((F.col("x") >= F.col("min")) & (F.col("x") <= F.col("max")), F.when(F.col("backwards"), F.col("n") - 1 - at).otherwise(at))
    return points.join(edges, key).withColumn("idx", found.cast("int")).drop("mids", "min", "max", "n", "backwards")


def exact_index_regular(points: DataFrame, axes: DataFrame) -> DataFrame:
    """points (grid_id, x) with idx of the axis value equal to x, null if there is none."""
    out = points.join(_axis(axes, "x", "_x"), "grid_id").withColumn("idx", geo.regular_exact(F.col("x"), *_on("_x")))
    return out.drop("_xfirst", "_xspacing", "_xsize", "_xis_longitude")


def exact_index_irregular(points: DataFrame, values: DataFrame, key: str = "axis_id") -> DataFrame:
    """points (key, x) with idx of the axis value equal to x, null if there is none."""
    return points.join(values.select(key, F.col("coord").alias("x"), "idx"), [key, "x"], "left")


def check_axis_monotonic(values: DataFrame, key: str = "axis_id") -> DataFrame:
    """(key, n, ok): whether an axis is strictly monotonic in the order of idx."""
    step = F.col("coord") - F.lag("coord").over(Window.partitionBy(key).orderBy("idx"))
    signs = values.withColumn("step", step).groupBy(key).agg(F.count("*").alias("n"), F.coalesce(F.every(F.col("step") > 0), F.lit(True)).alias("up"), F.coalesce(F.every(F.col("step") < 0), F.lit(True)).alias("down"))
    return signs.select(key, "n", (F.col("up") | F.col("down")).alias("ok"))


def bad_regular_axes(axes: DataFrame) -> DataFrame:
    """Regular axes that are empty or have no spacing."""
    return axes.filter((F.col("size") <= 0) | (F.col("spacing") == 0) | F.col("spacing").isNull())


def target_grid(boxes: DataFrame) -> DataFrame:
    """(grid_id, pixel, col, row, x, y): the pixel centres of boxes (min_x, min_y, max_x, max_y, width, height).

    Rows run from the south, pixels along rows.
    """
    cols = boxes.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    x = F.col("min_x") + (F.col("col") + 0.5) * ((F.col("max_x") - F.col("min_x")) / F.col("width"))
    y = F.col("min_y") + (F.col("row") + 0.5) * ((F.col("max_y") - F.col("min_y")) / F.col("height"))
    return cols.select("grid_id", (F.col("row").cast("long") * F.col("width") + F.col("col")).alias("pixel"), "col", "row", x.alias("x"), y.alias("y"))


def pixel_to_position(clicks: DataFrame) -> DataFrame:
    """clicks (px, py from the top, and the box of the image) with x, y and an error for clicks outside."""
    row = F.col("height") - F.col("py") - 1
    ok = (F.col("px") >= 0) & (F.col("px") < F.col("width")) & (F.col("py") >= 0) & (F.col("py") < F.col("height"))
    x = F.col("min_x") + (F.col("px") + 0.5) * ((F.col("max_x") - F.col("min_x")) / F.col("width"))
    y = F.col("min_y") + (row + 0.5) * ((F.col("max_y") - F.col("min_y")) / F.col("height"))
    return clicks.withColumn("x", F.when(ok, x)).withColumn("y", F.when(ok, y)).withColumn("error", F.when(~ok, F.lit("outside the image")))


def linear_index(coords: list[Column], low: list[int], high: list[int]) -> Column:
    """Row-major index of coordinates in an envelope, last dimension fastest; -1 outside."""
    index, inside = F.lit(0).cast("long"), F.lit(True)
    for c, a, b in zip(coords, low, high, strict=True):
        index = index * (b - a + 1) + (c - a)
        inside = inside & (c >= a) & (c <= b)
    return F.when(inside, index).otherwise(F.lit(-1).cast("long"))


def grid_coordinates(index: Column, low: list[int], high: list[int]) -> list[Column]:
    """The coordinates of a row-major index."""
    out, step = [], 1
    for a, b in reversed(list(zip(low, high, strict=True))):
        out.append((F.floor(index / step) % (b - a + 1) + a).cast("int"))
        step *= b - a + 1
    return out[::-1]


SAMPLED = 20  # coordinates looked at for each range


def order_grid_coordinates(df: DataFrame, col: str, per_range: int = 500_000, most: int = 512) -> DataFrame:
    """df with rank: fewer dimensions first, then by each coordinate; equal coordinates share a rank.

    The distinct coordinates are cut into ranges of about ``per_range`` (``most`` ranges at most) by the quantiles of a
    sample, counted by range, and numbered within their range, so that no task orders them all.  The driver holds SAMPLED
    coordinates a range.
    """
    distinct = df.select(F.col(col).alias("_c")).distinct()
    ranges = min(most, -(-distinct.count() // per_range)) if not df.isEmpty() else 1
    bounds = _range_bounds(distinct, ranges) if ranges > 1 else []
    kind = dict(distinct.dtypes)["_c"]
    size, c = F.size("_c"), F.col("_c")
    before = F.lit(0)
    if bounds:
        listed = F.from_json(F.lit(json.dumps(bounds)), f"array<{kind}>")
        before = F.size(F.filter(listed, lambda b: (size > F.size(b)) | ((size == F.size(b)) & (c > b))))
    placed = distinct.withColumn("_range", before)
    counts = {r["_range"]: r["count"] for r in placed.groupBy("_range").count().collect()} if bounds else {}
    shift = F.lit(0).cast("long")
    for k in sorted(counts, reverse=True):
        shift = F.when(F.col("_range") == k, F.lit(sum(n for j, n in counts.items() if j < k)).cast("long")).otherwise(shift)
    own = F.row_number().over(Window.partitionBy("_range").orderBy(size, c))
    ranked = placed.select("_c", (own + shift).cast("int").alias("rank"))
    return df.join(ranked, df[col].eqNullSafe(ranked["_c"])).drop("_c")


def _range_bounds(distinct: DataFrame, ranges: int) -> list:
    """Coordinates that cut the distinct ones into about equal ranges, ascending."""
    share = min(1.0, SAMPLED * ranges / max(1, distinct.count()))
    seen = sorted((r[0] for r in distinct.sample(share, seed=1).filter("_c is not null").collect()), key=lambda c: (len(c), c))
    return [seen[len(seen) * k // ranges] for k in range(1, ranges)] if seen else []


def parse_bbox(df: DataFrame, text: str = "bbox", lon_first: Column | None = None) -> DataFrame:
    """df with min_x, min_y, max_x, max_y and error; latitude comes first where lon_first is false."""
    parts = F.split(F.col(text), ",")
    n = [F.try_element_at(parts, F.lit(k)).try_cast("double") for k in (1, 2, 3, 4)]
    lon_first = F.lit(True) if lon_first is None else lon_first
    order = [(n[0], n[1]), (n[1], n[0]), (n[2], n[3]), (n[3], n[2])]
    box = [F.when(lon_first, a).otherwise(b) for a, b in order]
    bad = (F.when(F.col(text).isNull() | (F.size(parts) != 4), "need four elements")
           .when(n[0].isNull() | n[1].isNull() | n[2].isNull() | n[3].isNull(), "all elements must be numeric")
           .when((box[0] >= box[2]) | (box[1] >= box[3]), "minimum not below maximum"))
    out = df.withColumn("error", bad)
    for name, c in zip(("min_x", "min_y", "max_x", "max_y"), box, strict=True):
        out = out.withColumn(name, F.when(F.col("error").isNull(), c))
    return out


def normalise_bbox(df: DataFrame) -> DataFrame:
    """Boxes (min_x, min_y, max_x, max_y): a dimension that crosses the date line, is empty or NaN spans the globe."""
    out = df
    for a, b, globe in (("min_x", "max_x", 180.0), ("min_y", "max_y", 90.0)):
        wrong = (F.col(a) >= F.col(b)) & ~F.isnan(a) & ~F.isnan(b)
        low, high = F.when(wrong, -globe).otherwise(F.nanvl(F.col(a), F.lit(-globe))), F.when(wrong, globe).otherwise(F.nanvl(F.col(b), F.lit(globe)))
        out = out.withColumns({a: low, b: high})
    return out


def intersect_bbox(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every pair of boxes of a (a_id) and b (b_id) that overlap, with the intersection.

    Boxes meet on tiles of their own size (see tiles.overlaps), so that many small boxes in one place don't meet all others
    there, and a box of the whole globe isn't cut into small tiles.
    """
    return tiles.overlaps(a, b)


def transform_crs(df: DataFrame, source: str, target: str, x: str = "x", y: str = "y") -> DataFrame:
    """df with x and y moved from one coordinate reference system to another, longitude first."""
    if source == target or {source, target} <= set(geo.LON_LAT):
        return df
    lon, lat = geo.unproject(F.col(x), F.col(y), source)
    px, py = geo.project(lon, lat, target)
    return df.withColumns({x: px, y: py})


def polar_cell_index(df: DataFrame) -> DataFrame:
    """df (lon, lat) with row and col on the 721 x 721 polar grid, null outside the northern hemisphere."""
    row, col = geo.polar_cell(F.col("lon"), F.col("lat"))
    return df.withColumns({"row": row, "col": col})


def projected_nearest(points: DataFrame, axes: DataFrame, crs: str) -> DataFrame:
    """points (grid_id, x = longitude, y = latitude) with i, j on a grid whose axes are in another system."""
    moved = points.withColumns({"_lon": F.col("x"), "_lat": F.col("y")})
    found = nearest_index_regular(transform_crs(moved, "CRS:84", crs), axes)
    return found.withColumns({"x": F.col("_lon"), "y": F.col("_lat")}).drop("_lon", "_lat")


def parse_linestring(lines: DataFrame, text: str = "linestring", lon_first: bool = True) -> DataFrame:
    """(line_id, seq, x, y, distance, fraction): the control points of "x1 y1, x2 y2, ..." with the way along the line.

    Lines that aren't two points or more of two numbers each have no rows; bad_linestrings() has them.
    """
    points = F.split(F.trim(F.col(text)), r"\s*,\s*")
    xy = lambda p: F.split(F.trim(p), r"\s+")
    number = lambda p, k: F.try_element_at(xy(p), F.lit(k)).try_cast("double")
    good = (F.size(points) >= 2) & F.forall(points, lambda p: (F.size(xy(p)) == 2) & number(p, 1).isNotNull() & number(p, 2).isNotNull())
    rows = lines.filter(good).select("line_id", F.posexplode(points).alias("seq", "p"))
    a, b = number(F.col("p"), 1), number(F.col("p"), 2)
    rows = rows.select("line_id", "seq", (a if lon_first else b).alias("x"), (b if lon_first else a).alias("y"))
    along = Window.partitionBy("line_id").orderBy("seq")
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(along), 2) + F.pow(F.col("y") - F.lag("y").over(along), 2))
    rows = rows.withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn("distance", F.sum("step").over(along))
    whole = F.max("distance").over(Window.partitionBy("line_id"))
    return rows.select("line_id", "seq", "x", "y", "distance", F.coalesce(F.try_divide("distance", whole), F.lit(0.0)).alias("fraction"))


def bad_linestrings(lines: DataFrame, text: str = "linestring") -> DataFrame:
    good = parse_linestring(lines, text).select("line_id").distinct()
    return lines.join(good, "line_id", "left_anti")


def empty_points(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "point_id bigint, x double, y double, crs string")
