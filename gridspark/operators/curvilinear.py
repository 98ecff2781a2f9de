"""Curvilinear grids: corners, polygons and lookups (CUR).

Cells are (grid_id, i, j, lon, lat); a null centre is a cell without a place, and so is a missing row.
Lookups join points and cells on tiles of the globe, so no point is held against all cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.geo import constrain_longitude_180
from gridspark.operators import tiles


def nearer(ref: Column, lon: Column) -> Column:
    """A longitude in (-180, 180], or the same 360 degrees on, whichever is nearer to ref; on a tie the latter."""
    other = F.when(ref < 0, lon - 360).otherwise(lon + 360)
    return F.when(F.abs(ref - lon) < F.abs(ref - other), lon).otherwise(other)


def grid_sizes(cells: DataFrame) -> DataFrame:
    """(grid_id, ni, nj), one row per grid."""
    return cells.groupBy("grid_id").agg((F.max("i") + 1).alias("ni"), (F.max("j") + 1).alias("nj"))


def _offsets(pairs: list[tuple[int, int]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("di"), F.lit(b).alias("dj")) for k, (a, b) in enumerate(pairs)])).alias("o")


def curv_corners(cells: DataFrame) -> DataFrame:
    """(grid_id, ci, cj, lon, lat): the (ni + 1) x (nj + 1) corners of grids of 3 x 3 cells or more.

    An inner corner is the mean of the four centres around it (null if one is missing), longitudes harmonised with the
    first; outer ones follow in a straight line from the two beside them, columns first, then rows.  Every inner corner is
    sent to itself and to the outer ones that it decides, so all come from one grouping.
    """
    sent = cells.withColumn("lon", constrain_longitude_180(F.col("lon"))).select("*", _offsets([(1, 1), (0, 1), (1, 0), (0, 0)]))
    role = lambda k, c: F.max(F.when(F.col("o.k") == k, F.col(c)))
    grouped = sent.groupBy("grid_id", (F.col("i") + F.col("o.di")).alias("ci"), (F.col("j") + F.col("o.dj")).alias("cj"))
    near = grouped.agg(*[role(k, c).alias(f"{c}{k}") for k in range(4) for c in ("lon", "lat")])
    lon = (F.col("lon0") + sum((nearer(F.col("lon0"), F.col(f"lon{k}")) for k in (2, 3)), nearer(F.col("lon0"), F.col("lon1")))) / 4
    lat = (F.col("lat0") + F.col("lat1") + F.col("lat2") + F.col("lat3")) / 4
    sizes = grid_sizes(cells).filter("ni >= 3 and nj >= 3")
    inner = near.join(sizes, "grid_id").filter("ci between 1 and ni - 1 and cj between 1 and nj - 1").select("grid_id", "ni", "nj", "ci", "cj", lon.alias("lon"), lat.alias("lat"))

    def reached(c: str, size: str) -> Column:
        """Where an inner corner is needed along an axis: at its own place, and for the outer corners beside it or one on."""
        k, n = F.col(c), F.col(size)
        to = lambda place, far: F.struct(place.cast("int").alias("at"), F.lit(far).alias("far"))
        places = [(F.lit(True), to(k, 0)), (k == 1, to(F.lit(0), 0)), (k == 2, to(F.lit(0), 1)), (k == n - 1, to(n, 0)), (k == n - 2, to(n, 1))]
        return F.explode(F.array_compact(F.array(*[F.when(when, place) for when, place in places])))

    sent = inner.withColumn("x", reached("ci", "ni")).withColumn("y", reached("cj", "nj"))
    part = lambda c, x, y: F.max(F.when((F.col("x.far") == x) & (F.col("y.far") == y), F.col(c)))
    parts = [part(c, x, y).alias(f"{c}{x}{y}") for c in ("lon", "lat") for x in (0, 1) for y in (0, 1)]
    beside = F.max((F.col("x.far") + F.col("y.far") == 0).cast("int")).alias("beside")
    met = sent.groupBy("grid_id", F.col("x.at").alias("ci"), F.col("y.at").alias("cj")).agg(F.max("ni").alias("ni"), F.max("nj").alias("nj"), beside, *parts).filter("beside = 1")
    outer = lambda c, size: (F.col(c) == 0) | (F.col(c) == F.col(size))

    def placed(c: str) -> Column:
        row = [F.when(outer("ci", "ni"), F.col(f"{c}0{y}") * 2 - F.col(f"{c}1{y}")).otherwise(F.col(f"{c}0{y}")) for y in (0, 1)]
        return F.when(outer("cj", "nj"), row[0] * 2 - row[1]).otherwise(row[0]).alias(c)

    return met.select("grid_id", "ci", "cj", placed("lon"), placed("lat"))


def curv_cell_polygons(cells: DataFrame) -> DataFrame:
    """cells with corners x0, y0 ... x3, y3, harmonised with the centre, and the box min_x, min_y, max_x, max_y."""
    corners = curv_corners(cells).withColumn("lon", constrain_longitude_180(F.col("lon"))).select("*", _offsets([(0, 0), (-1, 0), (-1, -1), (0, -1)]))
    role = lambda k, c: F.max(F.when(F.col("o.k") == k, F.col(c)))
    around = corners.groupBy("grid_id", (F.col("ci") + F.col("o.di")).alias("i"), (F.col("cj") + F.col("o.dj")).alias("j")).agg(*[role(k, c).alias(f"{c}{k}") for k in range(4) for c in ("lon", "lat")])
    own = cells.withColumn("lon", constrain_longitude_180(F.col("lon"))).join(around, ["grid_id", "i", "j"])
    out = own.select("grid_id", "i", "j", "lon", "lat", *[nearer(F.col("lon"), F.col(f"lon{k}")).alias(f"x{k}") for k in range(4)], *[F.col(f"lat{k}").alias(f"y{k}") for k in range(4)])
    whole = F.lit(True)
    for k in range(4):
        whole = whole & F.col(f"x{k}").isNotNull() & F.col(f"y{k}").isNotNull()
    side = lambda f, c: F.when(whole, f(*[f"{c}{k}" for k in range(4)]))
    return out.withColumns({"min_x": side(F.least, "x"), "min_y": side(F.least, "y"), "max_x": side(F.greatest, "x"), "max_y": side(F.greatest, "y")})


def curv_cell_area(polygons: DataFrame) -> DataFrame:
    """polygons with area, from sides and diagonals; null where a corner is missing."""
    sq = lambda a, b: F.pow(F.col(f"x{a}") - F.col(f"x{b}"), 2) + F.pow(F.col(f"y{a}") - F.col(f"y{b}"), 2)
    term = sq(1, 2) + sq(3, 0) - sq(0, 1) - sq(2, 3)
    area = F.sqrt(4 * sq(0, 2) * sq(1, 3) - term * term) / 4
    return polygons.withColumn("area", F.when(~F.isnan(area), area))


def curv_mean_area(polygons: DataFrame) -> DataFrame:
    """(grid_id, mean_area), cells without area left out."""
    return curv_cell_area(polygons).groupBy("grid_id").agg(F.avg("area").alias("mean_area"))


def curv_bbox(cells: DataFrame) -> DataFrame:
    """(grid_id, west, east, south, north) of the centres there are."""
    own = cells.filter("lon is not null and lat is not null").withColumn("lon", constrain_longitude_180(F.col("lon")))
    return own.groupBy("grid_id").agg(F.min("lon").alias("west"), F.max("lon").alias("east"), F.min("lat").alias("south"), F.max("lat").alias("north"))


def curv_neighbours(cells: DataFrame, kind: str = "all") -> DataFrame:
    """(grid_id, i, j, ni, nj, neighbour): neighbours by edge, corner or both that are inside the grid."""
    edge, corner = [(1, 0), (-1, 0), (0, 1), (0, -1)], [(1, 1), (1, -1), (-1, 1), (-1, -1)]
    pairs = {"edge": edge, "corner": corner, "all": edge + corner}[kind]
    sent = cells.select("grid_id", "i", "j", _offsets(pairs)).select("grid_id", "i", "j", (F.col("i") + F.col("o.di")).alias("ni"), (F.col("j") + F.col("o.dj")).alias("nj"), F.when(F.col("o.di") * F.col("o.dj") == 0, "edge").otherwise("corner").alias("neighbour"))
    there = cells.select("grid_id", F.col("i").alias("ni"), F.col("j").alias("nj"))
    return sent.join(there, ["grid_id", "ni", "nj"])


def _tile(c: Column, size: Column | float) -> Column:
    return F.floor(c / size).cast("long")


def curv_tile_index(polygons: DataFrame) -> DataFrame:
    """(grid_id, level, tx, ty, i, j, centre, x0, y0 ... x3, y3): cells with the tiles of their own size that they touch.

    Made once and kept (see sources.io.write_tile_index), then looked up many times.  Tile columns wrap at the date line.
    """
    corners = [f"{c}{k}" for k in range(4) for c in "xy"]
    dealt = tiles.in_tiles(tiles.with_level(polygons.filter("min_x is not null")))
    return dealt.select("grid_id", "level", F.pmod("tx", F.pow(F.lit(2.0), "level").cast("long")).alias("tx"), "ty", "i", "j", F.col("lon").alias("centre"), *corners)


def curv_containing(points: DataFrame, index: DataFrame) -> DataFrame:
    """points (point_id, grid_id, lon, lat) with i and j of the cell that contains them, null if none does.

    index: of curv_tile_index.  A point on a shared edge belongs to one cell (half-open crossings); of several cells the
    lowest j, then i.  A point looks at one tile on each level that its grid's cells have, mostly one or two levels, and
    meets a few cells there whatever the resolution.
    """
    own = points.withColumns({"level": F.lit(tiles.FINEST), "at": constrain_longitude_180(F.col("lon"))})
    own = tiles.at_levels(own, index, ("grid_id",))
    own = own.withColumns({"tx": F.pmod(tiles.tile(F.col("at"), F.col("level")), F.pow(F.lit(2.0), "level").cast("long")), "ty": tiles.tile(F.col("lat"), F.col("level"))})
    x, y = nearer(F.col("centre"), F.col("at")), F.col("lat")
    crossings = F.lit(0)
    for a, b in ((0, 1), (1, 2), (2, 3), (3, 0)):
        xa, ya, xb, yb = F.col(f"x{a}"), F.col(f"y{a}"), F.col(f"x{b}"), F.col(f"y{b}")
        crossings = crossings + F.when(((ya > y) != (yb > y)) & (x < (xb - xa) * F.try_divide(y - ya, yb - ya) + xa), 1).otherwise(0)
    hits = own.join(index, ["grid_id", "level", "tx", "ty"]).filter(crossings % 2 == 1)
    best = hits.groupBy("point_id").agg(F.min(F.struct("j", "i")).alias("c")).select("point_id", "c.i", "c.j")
    return points.join(best, "point_id", "left")


def curv_nearest(points: DataFrame, cells: DataFrame, max_distance: DataFrame) -> DataFrame:
    """points (point_id, grid_id, lon, lat) with i and j of the nearest centre by plain squared degrees.

    max_distance: (grid_id, max_distance).  A point has no cell unless a centre lies within that distance of it both in
    longitude and in latitude; ties go to the lowest j, then i.  Centres are sent to the nine tiles around them, of
    max_distance times the root of 2, so that a point looks at one tile.
    """
    reach = max_distance.withColumn("size", F.col("max_distance") * 2**0.5)
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("o")
    centres = cells.filter("lon is not null and lat is not null").withColumnsRenamed({"lon": "clon", "lat": "clat"}).join(reach, "grid_id")
    centres = centres.select("*", near).withColumns({"tx": _tile(F.col("clon"), F.col("size")) + F.col("o.a"), "ty": _tile(F.col("clat"), F.col("size")) + F.col("o.b")}).drop("o", "size")
    own = points.join(reach.select("grid_id", "size"), "grid_id").withColumns({"tx": _tile(F.col("lon"), F.col("size")), "ty": _tile(F.col("lat"), F.col("size"))})
    dx, dy = F.abs(F.col("lon") - F.col("clon")), F.abs(F.col("lat") - F.col("clat"))
    pairs = own.join(centres, ["grid_id", "tx", "ty"]).select("point_id", "i", "j", (dx * dx + dy * dy).alias("d2"), ((dx <= F.col("max_distance")) & (dy <= F.col("max_distance"))).alias("close"))
    best = pairs.groupBy("point_id").agg(F.min(F.struct("d2", "j", "i")).alias("c"), F.max("close").alias("close")).filter("close").select("point_id", "c.i", "c.j")
    return points.join(best, "point_id", "left")


def curv_range_query(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """(box_id, i, j) of all centres in closed boxes (box_id, grid_id, min_x, min_y, max_x, max_y).

    A box touches at most two by two tiles of its own size; a centre goes to one tile on each level that the boxes have.
    """
    wanted = tiles.with_level(boxes.filter("min_x <= max_x and min_y <= max_y"))
    centres = tiles.at_levels(cells.withColumn("level", F.lit(tiles.FINEST)), wanted, ("grid_id",))
    centres = centres.withColumns({"tx": tiles.tile(F.col("lon"), F.col("level")), "ty": tiles.tile(F.col("lat"), F.col("level"))})
    met = tiles.in_tiles(wanted).join(centres, ["grid_id", "level", "tx", "ty"])
    return met.filter("lon between min_x and max_x and lat between min_y and max_y").select("box_id", "i", "j")
