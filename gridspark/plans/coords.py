"""Queries of the axes and grids (GEO)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.functions import geo
from gridspark.operators import coords
from gridspark.plans.registry import query

C360 = "(CASE WHEN ({x}) % 360 < 0 THEN ({x}) % 360 + 360 ELSE ({x}) % 360 END)"


def c360(x: str) -> str:
    return C360.format(x=x)


#: Cell of the 36 x 18 world grid in SQL.
WORLD_I = f"CAST(greatest(0, least(35, floor((-180 + {c360('x + 180')} + 175) / 10 + 0.5))) AS INT)"
WORLD_J = "CAST(CASE WHEN y >= -90 AND y <= 90 THEN greatest(0, least(17, floor((y + 85) / 10 + 0.5))) END AS INT)"


@query("geo1_constrain_longitude", ("points",), f"""
SELECT point_id, CASE WHEN {c360('x * 3')} > 180 THEN {c360('x * 3')} - 360 ELSE {c360('x * 3')} END AS c180, {c360('x * 3')} AS c360 FROM points""")
def geo1(v):
    x = F.col("x") * 3
    return v.points.select("point_id", geo.constrain_longitude_180(x).alias("c180"), geo.constrain_longitude_360(x).alias("c360"))


@query("geo2_next_equivalent_longitude", ("points",), f"SELECT point_id, y + {c360('x * 2 - y')} AS next_lon FROM points")
def geo2(v):
    return v.points.select("point_id", geo.next_equivalent_longitude(F.col("y"), F.col("x") * 2).alias("next_lon"))


@query("geo3_axis_extent", ("part_axes",), """
SELECT grid_id, axis, CASE WHEN size = 1 THEN first ELSE least(first, first + (size - 1) * spacing) - abs(spacing) / 2 END AS min,
       CASE WHEN size = 1 THEN first ELSE greatest(first, first + (size - 1) * spacing) + abs(spacing) / 2 END AS max FROM part_axes""")
def geo3(v):
    return coords.axis_extent(v.part_axes)


@query("geo3_irregular_extent", ("axis_values",), """
WITH n AS (SELECT axis_id, coord, row_number() OVER (PARTITION BY axis_id ORDER BY coord) AS k, row_number() OVER (PARTITION BY axis_id ORDER BY coord DESC) AS r FROM axis_values)
SELECT axis_id, max(CASE WHEN k = 1 THEN coord END) - (coalesce(max(CASE WHEN k = 2 THEN coord END), max(CASE WHEN k = 1 THEN coord END)) - max(CASE WHEN k = 1 THEN coord END)) / 2 AS min,
       max(CASE WHEN r = 1 THEN coord END) + (max(CASE WHEN r = 1 THEN coord END) - coalesce(max(CASE WHEN r = 2 THEN coord END), max(CASE WHEN r = 1 THEN coord END))) / 2 AS max
FROM n GROUP BY axis_id""")
def geo3b(v):
    return coords.irregular_extent(v.axis_values)


@query("geo4_nearest_index_regular", ("points",), f"SELECT point_id, {WORLD_I} AS i, {WORLD_J} AS j FROM points")
def geo4(v):
    points = v.points.withColumn("grid_id", F.lit("world"))
    return coords.nearest_index_regular(points, v.world_axes).select("point_id", "i", "j")


@query("geo5_nearest_index_irregular", ("axis_points", "axis_values"), """
WITH n AS (SELECT axis_id, coord, row_number() OVER (PARTITION BY axis_id ORDER BY coord) AS k, row_number() OVER (PARTITION BY axis_id ORDER BY coord DESC) AS r FROM axis_values),
e AS (SELECT axis_id, max(CASE WHEN k = 1 THEN coord END) - (max(CASE WHEN k = 2 THEN coord END) - max(CASE WHEN k = 1 THEN coord END)) / 2 AS lo,
             max(CASE WHEN r = 1 THEN coord END) + (max(CASE WHEN r = 1 THEN coord END) - max(CASE WHEN r = 2 THEN coord END)) / 2 AS hi FROM n GROUP BY axis_id),
best AS (SELECT p.point_id, p.axis_id, arg_min(a.idx, {'d': abs(a.coord - p.x), 'c': a.coord}) AS idx FROM axis_points p JOIN axis_values a ON a.axis_id = p.axis_id GROUP BY 1, 2)
SELECT p.point_id, p.axis_id, p.x, CASE WHEN p.x >= e.lo AND p.x <= e.hi THEN b.idx END AS idx
FROM axis_points p JOIN e ON e.axis_id = p.axis_id JOIN best b ON b.point_id = p.point_id AND b.axis_id = p.axis_id""")
def geo5(v):
    return coords.nearest_index_irregular(v.axis_points, v.axis_values).select("point_id", "axis_id", "x", "idx")


@query("geo6_exact_index_regular", ("part_axes",), """
WITH p AS (SELECT event_id AS point_id, concat('g', CAST(event_id % 100 + 1 AS STRING)) AS grid_id, CAST(event_id % 57 - 20 AS DOUBLE) / 4 AS x FROM events)
SELECT p.point_id, p.grid_id, p.x, CAST(CASE WHEN (p.x - a.first) / a.spacing = floor((p.x - a.first) / a.spacing) AND (p.x - a.first) / a.spacing BETWEEN 0 AND a.size - 1 THEN (p.x - a.first) / a.spacing END AS INT) AS idx
FROM p JOIN part_axes a ON a.grid_id = p.grid_id""")
def geo6(v):
    e = v.table("events")
    points = e.select(F.col("event_id").alias("point_id"), F.concat(F.lit("g"), (F.col("event_id") % 100 + 1).cast("string")).alias("grid_id"), ((F.col("event_id") % 57 - 20).cast("double") / 4).alias("x"))
    return coords.exact_index_regular(points, v.part_axes).select("point_id", "grid_id", "x", "idx")


@query("geo6_exact_index_irregular", ("axis_points", "axis_values"), """
SELECT p.point_id, p.axis_id, p.x, a.idx FROM axis_points p LEFT JOIN axis_values a ON a.axis_id = p.axis_id AND a.coord = p.x""")
def geo6b(v):
    return coords.exact_index_irregular(v.axis_points, v.axis_values).select("point_id", "axis_id", "x", "idx")


@query("geo7_check_axis_monotonic", (), """
WITH a AS (SELECT CAST(o_custkey % 40 AS INT) AS axis_id, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) AS idx, CAST(CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 1000 = 7 THEN 0 ELSE o_orderkey END AS DOUBLE) AS coord FROM orders),
s AS (SELECT axis_id, coord - lag(coord) OVER (PARTITION BY axis_id ORDER BY idx) AS step FROM a)
SELECT axis_id, count(*) AS n, coalesce(bool_and(step > 0), true) OR coalesce(bool_and(step < 0), true) AS ok FROM s GROUP BY axis_id""")
def geo7(v):
    o = v.table("orders")
    coord = F.when((F.col("o_custkey") % 3 == 0) & (F.col("o_orderkey") % 1000 == 7), 0).otherwise(F.col("o_orderkey")).cast("double")
    return coords.check_axis_monotonic(o.select((F.col("o_custkey") % 40).cast("int").alias("axis_id"), F.col("o_orderkey").alias("idx"), coord.alias("coord")))


@query("geo8_target_grid", ("bboxes",), """
SELECT grid_id, CAST(r * width + c AS BIGINT) AS pixel, CAST(c AS INT) AS col, CAST(r AS INT) AS row, min_x + (c + 0.5::DOUBLE) * ((max_x - min_x) / width) AS x, min_y + (r + 0.5::DOUBLE) * ((max_y - min_y) / height) AS y
FROM bboxes, range(8) AS cc(c), range(4) AS rr(r)""")
def geo8(v):
    return coords.target_grid(v.bboxes)


@query("geo9_pixel_to_position", ("bboxes",), """
WITH k AS (SELECT event_id, concat('b', CAST(event_id % 25 AS STRING)) AS grid_id, CAST(user_id % 10 - 1 AS INT) AS px, CAST(event_id % 6 - 1 AS INT) AS py FROM events)
SELECT k.event_id, CASE WHEN px BETWEEN 0 AND width - 1 AND py BETWEEN 0 AND height - 1 THEN min_x + (px + 0.5::DOUBLE) * ((max_x - min_x) / width) END AS x,
       CASE WHEN px BETWEEN 0 AND width - 1 AND py BETWEEN 0 AND height - 1 THEN min_y + (height - py - 1 + 0.5::DOUBLE) * ((max_y - min_y) / height) END AS y,
       CASE WHEN NOT (px BETWEEN 0 AND width - 1 AND py BETWEEN 0 AND height - 1) THEN 'outside the image' END AS error
FROM k JOIN bboxes b ON b.grid_id = k.grid_id""")
def geo9(v):
    e = v.table("events")
    clicks = e.select("event_id", F.concat(F.lit("b"), (F.col("event_id") % 25).cast("string")).alias("grid_id"), (F.col("user_id") % 10 - 1).cast("int").alias("px"), (F.col("event_id") % 6 - 1).cast("int").alias("py"))
    return coords.pixel_to_position(clicks.join(v.bboxes, "grid_id")).select("event_id", "x", "y", "error")


@query("geo10_linear_index", (), """
WITH c AS (SELECT event_id, event_id % 6 AS a, user_id % 5 AS b, (event_id + user_id) % 8 AS c FROM events),
k AS (SELECT *, CASE WHEN a BETWEEN 1 AND 4 AND b BETWEEN 0 AND 3 AND c BETWEEN 2 AND 7 THEN ((a - 1) * 4 + b) * 6 + (c - 2) ELSE -1 END AS idx FROM c)
SELECT event_id, CAST(idx AS BIGINT) AS idx, CAST(floor(idx / 24) % 4 + 1 AS INT) AS a2, CAST(floor(idx / 6) % 4 AS INT) AS b2, CAST(idx % 6 + 2 AS INT) AS c2 FROM k WHERE idx >= 0""")
def geo10(v):
    e = v.table("events")
    low, high = [1, 0, 2], [4, 3, 7]
    c = e.select("event_id", (F.col("event_id") % 6).alias("a"), (F.col("user_id") % 5).alias("b"), ((F.col("event_id") + F.col("user_id")) % 8).alias("c"))
    c = c.select("event_id", coords.linear_index([F.col("a"), F.col("b"), F.col("c")], low, high).alias("idx")).filter("idx >= 0")
    return c.select("event_id", "idx", *[x.alias(n) for x, n in zip(coords.grid_coordinates(F.col("idx"), low, high), ("a2", "b2", "c2"), strict=True)])


@query("geo11_order_grid_coordinates", ("nested_coords",), """
SELECT event_id, CAST(dense_rank() OVER (ORDER BY len(c), c) AS INT) AS rank FROM nested_coords""")
def geo11(v):
    return coords.order_grid_coordinates(v.nested_coords, "c").select("event_id", "rank")


@query("geo12_parse_bbox", (), """
WITH t AS (SELECT event_id, event_id % 2 = 1 AS lon_first, CASE event_id % 7 WHEN 0 THEN '10,10,0,20' WHEN 1 THEN '1,2,3' WHEN 2 THEN 'a,1,2,3' ELSE concat(CAST(event_id % 50 AS STRING), ',', CAST(user_id % 60 AS STRING), ',60.5,80.25') END AS bbox FROM events),
p AS (SELECT *, string_split(bbox, ',') AS s FROM t),
n AS (SELECT *, TRY_CAST(s[1] AS DOUBLE) AS a, TRY_CAST(s[2] AS DOUBLE) AS b, TRY_CAST(s[3] AS DOUBLE) AS c, TRY_CAST(s[4] AS DOUBLE) AS d FROM p),
o AS (SELECT *, CASE WHEN lon_first THEN a ELSE b END AS x0, CASE WHEN lon_first THEN b ELSE a END AS y0, CASE WHEN lon_first THEN c ELSE d END AS x1, CASE WHEN lon_first THEN d ELSE c END AS y1 FROM n),
e AS (SELECT *, CASE WHEN len(s) <> 4 THEN 'need four elements' WHEN a IS NULL OR b IS NULL OR c IS NULL OR d IS NULL THEN 'all elements must be numeric' WHEN x0 >= x1 OR y0 >= y1 THEN 'minimum not below maximum' END AS error FROM o)
SELECT event_id, error, CASE WHEN error IS NULL THEN x0 END AS min_x, CASE WHEN error IS NULL THEN y0 END AS min_y, CASE WHEN error IS NULL THEN x1 END AS max_x, CASE WHEN error IS NULL THEN y1 END AS max_y FROM e""")
def geo12(v):
    k = F.col("event_id") % 7
    text = F.when(k == 0, "10,10,0,20").when(k == 1, "1,2,3").when(k == 2, "a,1,2,3").otherwise(F.concat((F.col("event_id") % 50).cast("string"), F.lit(","), (F.col("user_id") % 60).cast("string"), F.lit(",60.5,80.25")))
    out = coords.parse_bbox(v.table("events").withColumn("bbox", text), lon_first=F.col("event_id") % 2 == 1)
    return out.select("event_id", "error", "min_x", "min_y", "max_x", "max_y")


@query("geo13_normalise_bbox", ("views_bbox",), """
WITH b AS (SELECT view_id, min_x, min_y, CASE WHEN view_id % 5 = 0 THEN min_x - 10 ELSE max_x END AS max_x, CASE WHEN view_id % 7 = 0 THEN NULL WHEN view_id % 3 = 0 THEN min_y ELSE max_y END AS max_y FROM views_bbox)
SELECT view_id, CASE WHEN min_x >= max_x THEN -180 ELSE min_x END AS min_x, CASE WHEN min_y >= max_y THEN -90 ELSE min_y END AS min_y,
       CASE WHEN min_x >= max_x THEN 180 ELSE max_x END AS max_x, CASE WHEN min_y >= max_y THEN 90 ELSE coalesce(max_y, 90) END AS max_y FROM b""")
def geo13(v):
    b = v.views_bbox.withColumn("max_x", F.when(F.col("view_id") % 5 == 0, F.col("min_x") - 10).otherwise(F.col("max_x")))
    b = b.withColumn("max_y", F.when(F.col("view_id") % 7 == 0, F.lit(float("nan"))).when(F.col("view_id") % 3 == 0, F.col("min_y")).otherwise(F.col("max_y")))
    return coords.normalise_bbox(b).select("view_id", "min_x", "min_y", "max_x", "max_y")


@query("geo14_intersect_bbox", ("views_bbox", "bboxes"), """
SELECT a.view_id AS a_id, b.grid_id AS b_id, greatest(a.min_x, b.min_x) AS min_x, greatest(a.min_y, b.min_y) AS min_y, least(a.max_x, b.max_x) AS max_x, least(a.max_y, b.max_y) AS max_y
FROM views_bbox a JOIN bboxes b ON a.min_x <= b.max_x AND b.min_x <= a.max_x AND a.min_y <= b.max_y AND b.min_y <= a.max_y""")
def geo14(v):
    return coords.intersect_bbox(v.views_bbox.withColumnRenamed("view_id", "a_id"), v.bboxes.withColumnRenamed("grid_id", "b_id"))


@query("geo15_transform_crs", ("points",), """
SELECT point_id, round(radians(x) * 6378137.0, 4) AS mx, CASE WHEN y > -90 THEN round(ln(tan(pi() / 4 + radians(y) / 2)) * 6378137.0, 4) END AS my,
       round(2 * 6371228.0 * sin(pi() / 4 - radians(y) / 2) * sin(radians(x)), 4) AS nx, round(-2 * 6371228.0 * sin(pi() / 4 - radians(y) / 2) * cos(radians(x)), 4) AS ny,
       round(x, 4) AS back_x, round(y, 4) AS back_y FROM points""")
def geo15(v):
    p = v.points.select("point_id", "x", "y")
    out = p
    for crs, a in (("EPSG:3857", "m"), ("EPSG:3408", "n")):
        px, py = geo.project(F.col("x"), F.col("y"), crs)
        out = out.withColumns({a + "x": px, a + "y": py})
    back = coords.transform_crs(out.withColumns({"back_x": F.col("nx"), "back_y": F.col("ny")}), "EPSG:3408", "CRS:84", "back_x", "back_y")
    return back.select("point_id", *[F.round(c, 4).alias(c) for c in ("mx", "my", "nx", "ny")], F.round("back_x", 4).alias("back_x"), F.round("back_y", 4).alias("back_y"))


@query("geo16_polar_cell_index", ("points",), """
WITH r AS (SELECT point_id, y, radians(x) AS lam, 2 * 6371.228 / 25.067525 * sin(pi() / 4 - radians(y) / 2) AS rho FROM points)
SELECT point_id, CAST(CASE WHEN y BETWEEN 0 AND 90 THEN floor(360 + rho * cos(lam) + 0.5) END AS INT) AS row, CAST(CASE WHEN y BETWEEN 0 AND 90 THEN floor(360 + rho * sin(lam) + 0.5) END AS INT) AS col FROM r""")
def geo16(v):
    return coords.polar_cell_index(v.points.withColumnsRenamed({"x": "lon", "y": "lat"})).select("point_id", "row", "col")


@query("geo17_projected_nearest", ("points",), """
WITH m AS (SELECT point_id, radians(x) * 6378137.0 AS mx, CASE WHEN y > -90 THEN ln(tan(pi() / 4 + radians(y) / 2)) * 6378137.0 END AS my FROM points)
SELECT point_id, CAST(CASE WHEN mx BETWEEN -2.05e7 AND 2.05e7 THEN greatest(0, least(40, floor((mx + 2e7) / 1e6 + 0.5))) END AS INT) AS i, CAST(CASE WHEN my BETWEEN -1.05e7 AND 1.05e7 THEN greatest(0, least(20, floor((my + 1e7) / 1e6 + 0.5))) END AS INT) AS j FROM m""")
def geo17(v):
    one = v.table("region").limit(1)
    axes = one.select(F.lit("m").alias("grid_id"), F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(f).alias("first"), F.lit(1e6).alias("spacing"), F.lit(n).alias("size"), F.lit(False).alias("is_longitude")) for a, f, n in (("x", -2e7, 41), ("y", -1e7, 21))])).alias("a")).select("grid_id", "a.*")
    points = v.points.withColumn("grid_id", F.lit("m"))
    return coords.projected_nearest(points, axes, "EPSG:3857").select("point_id", "i", "j")


LINE_SQL = """
WITH p AS (SELECT line_id, unnest(string_split(linestring, ',')) AS p, generate_subscripts(string_split(linestring, ','), 1) - 1 AS seq FROM lines),
xy AS (SELECT line_id, seq, CAST(regexp_split_to_array(trim(p), '\\s+')[1] AS DOUBLE) AS x, CAST(regexp_split_to_array(trim(p), '\\s+')[2] AS DOUBLE) AS y FROM p),
st AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step FROM xy WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
control AS (SELECT line_id, CAST(seq AS INT) AS seq, x, y, sum(step) OVER (PARTITION BY line_id ORDER BY seq) AS distance, sum(step) OVER (PARTITION BY line_id ORDER BY seq) / sum(step) OVER (PARTITION BY line_id) AS fraction FROM st)
""".replace("\\\\", "\\")


@query("geo18_parse_linestring", ("lines",), LINE_SQL + "SELECT line_id, seq, x, y, round(distance, 6) AS distance, round(fraction, 9) AS fraction FROM control")
def geo18(v):
    return coords.parse_linestring(v.lines).withColumns({"distance": F.round("distance", 6), "fraction": F.round("fraction", 9)})


@query("geo19_dedupe_whitespace", ("lines",), r"SELECT line_id, regexp_replace(linestring, '\s+', ' ', 'g') AS text FROM lines")
def geo19(v):
    return v.lines.select("line_id", geo.dedupe_whitespace(F.col("linestring")).alias("text"))
