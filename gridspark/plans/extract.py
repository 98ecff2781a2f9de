"""Queries of maps, series, profiles, transects, sections and tiles (EXT), vectors (VEC)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.operators import coords, extract, vectors
from gridspark.plans.coords import LINE_SQL, WORLD_I, WORLD_J
from gridspark.plans.registry import query
from gridspark.plans.views import Views

WORLD = "world"


def boxes(v: Views):
    return v.bboxes.withColumn("source_id", F.lit(WORLD))


PIXELS = """
px AS (SELECT grid_id, CAST(r * width + c AS BIGINT) AS pixel, CAST(c AS INT) AS col, CAST(r AS INT) AS row, min_x + (c + 0.5::DOUBLE) * ((max_x - min_x) / width) AS x, min_y + (r + 0.5::DOUBLE) * ((max_y - min_y) / height) AS y
       FROM bboxes, range(8) AS cc(c), range(4) AS rr(r)),
""" + f"pm AS (SELECT grid_id, pixel, col, row, {WORLD_I} AS i, {WORLD_J} AS j FROM px WHERE abs(y) <= 90)"


@query("ext1_pixel_map", ("bboxes",), f"WITH {PIXELS} SELECT * FROM pm")
def ext1(v):
    return extract.pixel_map(v.world_axes, boxes(v)).drop("source_id")


@query("ext2_point_map", ("points",), f"SELECT point_id, x, y, {WORLD_I} AS i, {WORLD_J} AS j FROM points")
def ext2(v):
    return extract.point_map(v.world_axes, v.points.withColumn("grid_id", F.lit(WORLD))).select("point_id", "x", "y", "i", "j")


@query("ext3_group_by_source_cell", ("bboxes",), f"WITH {PIXELS} SELECT grid_id, j, i, string_agg(CAST(pixel AS STRING), ',' ORDER BY pixel) AS pixels FROM pm GROUP BY 1, 2, 3")
def ext3(v):
    out = extract.group_by_source_cell(extract.pixel_map(v.world_axes, boxes(v)))
    return out.withColumn("pixels", F.array_join(F.col("pixels").cast("array<string>"), ","))


@query("ext4_pixel_map_stats", ("bboxes",), f"""WITH {PIXELS}
SELECT grid_id, count(DISTINCT i * 1000 + j) AS cells, min(i) AS min_i, max(i) AS max_i, min(j) AS min_j, max(j) AS max_j, CAST((max(i) - min(i) + 1) * (max(j) - min(j) + 1) AS BIGINT) AS box_size FROM pm GROUP BY grid_id""")
def ext4(v):
    return extract.pixel_map_stats(extract.pixel_map(v.world_axes, boxes(v)))


FRAME = "(SELECT DISTINCT t FROM cells WHERE layer_id = 'A' AND z_index = 1)"


def frames(v: Views):
    times = v.cells.filter("layer_id = 'A' and z_index = 1").select("layer_id", "t", "z_index").distinct()
    return v.bboxes.select("grid_id").crossJoin(times)


@query("ext5_read_horizontal", ("cells", "bboxes"), f"""WITH {PIXELS}, one AS (SELECT min(t) AS t FROM cells WHERE layer_id = 'A')
SELECT pm.grid_id, pm.pixel, pm.col, pm.row, c.value FROM pm CROSS JOIN one LEFT JOIN cells c ON c.layer_id = 'A' AND c.t = one.t AND c.z_index = 0 AND c.j = pm.j AND c.i = pm.i""")
def ext5(v):
    """A map of one layer at its first time and level."""
    first = v.cells.filter("layer_id = 'A'").agg(F.min("t").alias("t")).select(F.lit("A").alias("layer_id"), "t", F.lit(0).alias("z_index"))
    pixels = extract.pixel_map(v.world_axes, boxes(v)).crossJoin(F.broadcast(first))  # one row
    return extract.read_horizontal(v.cells, pixels).select("grid_id", "pixel", "col", "row", "value")


def requests(v: Views):
    return v.requests.withColumn("grid_id", F.lit(WORLD))


REQ = f"rq AS (SELECT *, {WORLD_I} AS i, {WORLD_J} AS j FROM requests)"


@query("ext6_read_single_points", ("cells", "requests"), f"""WITH {REQ}
SELECT rq.request_id, rq.i, rq.j, c.value FROM rq LEFT JOIN cells c ON c.layer_id = rq.layer_id AND c.t = rq.t AND c.z_index = rq.z_index AND c.j = rq.j AND c.i = rq.i""")
def ext6(v):
    return extract.read_single_points(v.cells, v.world_axes, requests(v)).select("request_id", "i", "j", "value")


@query("ext7_read_timeseries", ("cells", "requests"), f"""WITH {REQ}, ts AS (SELECT DISTINCT layer_id, t FROM cells)
SELECT rq.request_id, ts.t, c.value FROM rq JOIN ts ON ts.layer_id = rq.layer_id
LEFT JOIN cells c ON c.layer_id = rq.layer_id AND c.t = ts.t AND c.z_index = rq.z_index AND c.j = rq.j AND c.i = rq.i""")
def ext7(v):
    steps = v.cells.select("layer_id", "t").distinct()
    return extract.read_timeseries(v.cells, steps, v.world_axes, requests(v).drop("t"))


@query("ext8_vertical_profile", ("cells", "requests", "z_axis"), f"""WITH {REQ}
SELECT rq.request_id, c.z_index, z.z, c.value FROM rq JOIN cells c ON c.layer_id = rq.layer_id AND c.t = rq.t AND c.j = rq.j AND c.i = rq.i JOIN z_axis z ON z.layer_id = c.layer_id AND z.z_index = c.z_index""")
def ext8(v):
    return extract.vertical_profile(v.cells, v.z_axis, v.world_axes, requests(v).drop("z_index"))


def path_sql(n: str) -> str:
    """Points k of n on every line, in SQL: n is an expression or a list."""
    return LINE_SQL.strip() + f""",
nn AS (SELECT unnest({n}) AS n),
kk AS (SELECT c.line_id, nn.n, unnest(range(nn.n)) AS k, max(c.distance) AS whole FROM control c CROSS JOIN nn GROUP BY c.line_id, nn.n),
s AS (SELECT line_id, n, k, whole * k / (n - 1) AS s FROM kk),
seg AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(distance) OVER w AS d2 FROM control WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
hit AS (SELECT s.line_id, s.n, s.k, s.s, max(seg.seq) AS seq FROM s JOIN seg ON seg.line_id = s.line_id AND seg.d2 IS NOT NULL AND (seg.distance <= s.s OR seg.seq = 0) GROUP BY ALL),
path AS (SELECT p.line_id, CAST(p.n AS INT) AS n, CAST(p.k AS INT) AS k, seg.x + CASE WHEN k = 0 THEN 0 WHEN k = n - 1 THEN 1 ELSE (p.s - seg.distance) / (seg.d2 - seg.distance) END * (seg.x2 - seg.x) AS x,
         seg.y + CASE WHEN k = 0 THEN 0 WHEN k = n - 1 THEN 1 ELSE (p.s - seg.distance) / (seg.d2 - seg.distance) END * (seg.y2 - seg.y) AS y FROM hit p JOIN seg ON seg.line_id = p.line_id AND seg.seq = p.seq)
"""


@query("ext9_points_on_path", ("lines",), path_sql("[37]") + "SELECT line_id, n, k, round(x, 6) AS x, round(y, 6) AS y FROM path")
def ext9(v):
    out = extract.points_on_path(coords.parse_linestring(v.lines), 37)
    return out.select("line_id", "n", "k", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("ext10_optimal_transect", ("lines",), path_sql("range(10, 201, 10)") + f""",
mp AS (SELECT line_id, n, {WORLD_I.replace('x +', 'round(x, 9) +')} AS i, {WORLD_J.replace('y', 'round(y, 9)')} AS j FROM path),
ct AS (SELECT line_id, n, count(DISTINCT CASE WHEN i IS NOT NULL AND j IS NOT NULL THEN i * 1000 + j END) + max(CASE WHEN i IS NULL OR j IS NULL THEN 1 ELSE 0 END) AS cells FROM mp GROUP BY 1, 2),
bf AS (SELECT *, lag(cells) OVER (PARTITION BY line_id ORDER BY n) AS before FROM ct),
ch AS (SELECT line_id, coalesce(min(CASE WHEN cells <= before * 1.1::DOUBLE THEN n END) - 10, 200) AS n FROM bf GROUP BY line_id)
SELECT ch.line_id, CAST(ch.n AS INT) AS n, ct.cells FROM ch JOIN ct ON ct.line_id = ch.line_id AND ct.n = ch.n""")
def ext10(v):
    control = coords.parse_linestring(v.lines)
    chosen = extract.optimal_transect(control, v.world_axes, WORLD, step=10, most=200)
    rounded = chosen.withColumns({"grid_id": F.lit(WORLD), "x": F.round("x", 9), "y": F.round("y", 9)})
    return extract.distinct_cells_sampled(extract.point_map(v.world_axes, rounded), ("line_id", "n"))


TRANSECT = path_sql("[40]") + f""",
mp AS (SELECT line_id, k, {WORLD_I.replace('x +', 'round(x, 9) +')} AS i, {WORLD_J.replace('y', 'round(y, 9)')} AS j FROM path),
one AS (SELECT min(t) AS t FROM cells WHERE layer_id = 'N')"""


def transect_points(v: Views):
    points = extract.points_on_path(coords.parse_linestring(v.lines), 40).select("line_id", "k", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), F.lit(WORLD).alias("grid_id"), F.lit("N").alias("layer_id"))
    first = v.cells.filter("layer_id = 'N'").agg(F.min("t").alias("t"))
    return points.crossJoin(F.broadcast(first))  # one row


@query("ext11_transect", ("cells", "lines"), TRANSECT + """
SELECT mp.line_id, mp.k, c.value FROM mp CROSS JOIN one LEFT JOIN cells c ON c.layer_id = 'N' AND c.t = one.t AND c.z_index = 2 AND c.j = mp.j AND c.i = mp.i""")
def ext11(v):
    return extract.transect(v.cells, v.world_axes, transect_points(v).withColumn("z_index", F.lit(2))).select("line_id", "k", "value")


SPEED = """cm AS (SELECT t, z_index, j, i, max(CASE WHEN layer_id = 'A' THEN value END) AS east, max(CASE WHEN layer_id = 'N' THEN value END) AS north FROM cells WHERE layer_id IN ('A', 'N') GROUP BY 1, 2, 3, 4),
vc AS (SELECT layer_id, t, z_index, j, i, value FROM cells UNION ALL SELECT 'speed', t, z_index, j, i, sqrt(east * east + north * north) FROM cm)"""


def speed(v: Views):
    """The one vector layer of the queries."""
    return v.table("region").filter("r_regionkey = 0").select(F.lit("speed").alias("layer_id"), F.lit("A").alias("east_id"), F.lit("N").alias("north_id"))


@query("ext11_transect_vector", ("cells", "lines"), TRANSECT + f""", {SPEED}
SELECT mp.line_id, mp.k, round(c.value, 6) AS value FROM mp CROSS JOIN one LEFT JOIN vc c ON c.layer_id = 'speed' AND c.t = one.t AND c.z_index = 2 AND c.j = mp.j AND c.i = mp.i""")
def ext11b(v):
    points = transect_points(v).withColumns({"z_index": F.lit(2), "layer_id": F.lit("speed")})
    return extract.transect(v.cells, v.world_axes, points, speed(v)).select("line_id", "k", F.round("value", 6).alias("value"))


SECTION = TRANSECT + """,
sc AS (SELECT mp.line_id, mp.k, z.z_index, z.z, c.value FROM mp CROSS JOIN one JOIN z_axis z ON z.layer_id = 'N' LEFT JOIN cells c ON c.layer_id = 'N' AND c.t = one.t AND c.z_index = z.z_index AND c.j = mp.j AND c.i = mp.i),
section AS (SELECT * FROM sc QUALIFY count(value) OVER (PARTITION BY line_id, z_index) > 0)"""


@query("ext12_vertical_section", ("cells", "lines", "z_axis"), SECTION + "SELECT line_id, k, z_index, z, value FROM section")
def ext12(v):
    return extract.vertical_section(v.cells, v.z_axis, v.world_axes, transect_points(v)).select("line_id", "k", "z_index", "z", "value")


@query("ext13_resample_section", ("cells", "lines", "z_axis"), SECTION + """,
lv AS (SELECT DISTINCT line_id, z_index, z FROM section),
sp AS (SELECT line_id, min(z) AS low, max(z) AS high FROM lv GROUP BY line_id),
ht AS (SELECT line_id, h, low + h * ((high - low) / 15) AS height FROM sp, range(16) AS r(h)),
nr AS (SELECT ht.line_id, ht.h, ht.height, arg_min(lv.z_index, {'d': abs(lv.z - ht.height), 'k': lv.z_index}) AS z_index FROM ht JOIN lv ON lv.line_id = ht.line_id GROUP BY 1, 2, 3)
SELECT nr.line_id, CAST(nr.h AS INT) AS h, round(nr.height, 6) AS height, s.k, s.value FROM nr JOIN section s ON s.line_id = nr.line_id AND s.z_index = nr.z_index""")
def ext13(v):
    section = extract.vertical_section(v.cells, v.z_axis, v.world_axes, transect_points(v))
    return extract.resample_section(section, 16).withColumn("height", F.round("height", 6))


@query("ext14_feature_info", ("cells", "bboxes"), f"""
WITH k AS (SELECT event_id AS request_id, concat('b', CAST(event_id % 25 AS STRING)) AS grid_id, CAST(user_id % 10 - 1 AS INT) AS px, CAST(event_id % 6 - 1 AS INT) AS py, CASE user_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS layer_id, CAST(event_id % 7 AS INT) AS z_index FROM events),
pl AS (SELECT k.request_id, k.layer_id, k.z_index, min_x + (px + 0.5::DOUBLE) * ((max_x - min_x) / width) AS x, min_y + (height - py - 1 + 0.5::DOUBLE) * ((max_y - min_y) / height) AS y FROM k JOIN bboxes b ON b.grid_id = k.grid_id WHERE px BETWEEN 0 AND width - 1 AND py BETWEEN 0 AND height - 1),
rq AS (SELECT *, {WORLD_I} AS i, {WORLD_J} AS j FROM pl), ts AS (SELECT DISTINCT layer_id, t FROM cells)
SELECT rq.request_id, rq.x AS lon, rq.y AS lat, rq.i, rq.j, CAST(-175 + 10 * rq.i AS DOUBLE) AS cell_x, CAST(-85 + 10 * rq.j AS DOUBLE) AS cell_y, count(c.value) AS n, count(*) AS steps, round(sum(c.value), 2) AS total
FROM rq JOIN ts ON ts.layer_id = rq.layer_id LEFT JOIN cells c ON c.layer_id = rq.layer_id AND c.t = ts.t AND c.z_index = rq.z_index AND c.j = rq.j AND c.i = rq.i GROUP BY ALL""")
def ext14(v):
    e = v.table("events")
    clicks = e.select(F.col("event_id").alias("request_id"), F.concat(F.lit("b"), (F.col("event_id") % 25).cast("string")).alias("box"), (F.col("user_id") % 10 - 1).cast("int").alias("px"), (F.col("event_id") % 6 - 1).cast("int").alias("py"),
                      F.when(F.col("user_id") % 3 == 0, "A").when(F.col("user_id") % 3 == 1, "N").otherwise("R").alias("layer_id"), (F.col("event_id") % 7).cast("int").alias("z_index"))
    clicks = clicks.join(v.bboxes.withColumnRenamed("grid_id", "box"), "box").withColumn("grid_id", F.lit(WORLD))
    out = extract.feature_info(v.cells, v.cells.select("layer_id", "t").distinct(), v.world_axes, clicks)
    values = F.filter(F.col("series")["value"], lambda x: x.isNotNull())
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    return out.select("request_id", "lon", "lat", "i", "j", "cell_x", "cell_y", F.size(values).cast("long").alias("n"), F.size("series").cast("long").alias("steps"), F.round(F.when(F.size(values) > 0, total), 2).alias("total"))


@query("ext14_feature_info_vector", ("cells", "bboxes"), f"""
WITH {SPEED}, k AS (SELECT event_id AS request_id, concat('b', CAST(event_id % 25 AS STRING)) AS grid_id, CAST(user_id % 8 AS INT) AS px, CAST(event_id % 4 AS INT) AS py, CAST(event_id % 7 AS INT) AS z_index FROM events WHERE event_type = 'click'),
pl AS (SELECT k.request_id, k.z_index, min_x + (px + 0.5::DOUBLE) * ((max_x - min_x) / width) AS x, min_y + (height - py - 1 + 0.5::DOUBLE) * ((max_y - min_y) / height) AS y FROM k JOIN bboxes b ON b.grid_id = k.grid_id),
rq AS (SELECT *, {WORLD_I} AS i, {WORLD_J} AS j FROM pl), ts AS (SELECT DISTINCT t FROM vc WHERE layer_id = 'speed')
SELECT rq.request_id, ts.t, round(c.value, 6) AS value FROM rq CROSS JOIN ts LEFT JOIN vc c ON c.layer_id = 'speed' AND c.t = ts.t AND c.z_index = rq.z_index AND c.j = rq.j AND c.i = rq.i""")
def ext14b(v):
    e = v.table("events").filter("event_type = 'click'")
    clicks = e.select(F.col("event_id").alias("request_id"), F.concat(F.lit("b"), (F.col("event_id") % 25).cast("string")).alias("box"), (F.col("user_id") % 8).cast("int").alias("px"), (F.col("event_id") % 4).cast("int").alias("py"), F.lit("speed").alias("layer_id"), (F.col("event_id") % 7).cast("int").alias("z_index"))
    clicks = clicks.join(v.bboxes.withColumnRenamed("grid_id", "box"), "box").withColumn("grid_id", F.lit(WORLD))
    steps = v.cells.filter("layer_id in ('A', 'N')").select(F.lit("speed").alias("layer_id"), "t").distinct()
    out = extract.feature_info(v.cells, steps, v.world_axes, clicks, speed(v))
    return out.select("request_id", F.explode("series").alias("s")).select("request_id", "s.t", F.round("s.value", 6).alias("value"))


@query("ext15_map_frames", ("cells", "bboxes"), f"""WITH {PIXELS}, fr AS {FRAME}
SELECT pm.grid_id, fr.t, pm.pixel, c.value, CASE WHEN (SELECT count(*) FROM fr) > 1 THEN strftime(fr.t, '%Y-%m-%d') END AS label
FROM pm CROSS JOIN fr LEFT JOIN cells c ON c.layer_id = 'A' AND c.t = fr.t AND c.z_index = 1 AND c.j = pm.j AND c.i = pm.i""")
def ext15(v):
    return extract.map_frames(v.cells, v.world_axes, boxes(v), frames(v)).select("grid_id", "t", "pixel", "value", "label")


@query("ext16_tile_grid", ("layers",), """
WITH z AS (SELECT layer_id, unnest([1, 2]) AS zoom FROM layers),
t AS (SELECT layer_id, zoom, 360.0::DOUBLE / pow(2, zoom) AS span, unnest(range(CAST(pow(2, zoom - 1) AS BIGINT))) AS tile_row FROM z),
u AS (SELECT *, unnest(range(CAST(pow(2, zoom) AS BIGINT))) AS tile_col FROM t)
SELECT layer_id, CAST(zoom AS INT) AS zoom, CAST(tile_row AS INT) AS tile_row, CAST(tile_col AS INT) AS tile_col, tile_col * span - 180 AS min_x, tile_row * span - 90 AS min_y, tile_col * span - 180 + span AS max_x, tile_row * span - 90 + span AS max_y FROM u""")
def ext16a(v):
    return extract.tile_grid(v.layers.select("layer_id"), (1, 2))


@query("ext16_tile_pyramid", ("cells",), """
WITH zz AS (SELECT unnest([1, 2, 3]) AS zoom),
cs AS (SELECT zoom, k, CAST(floor(((k + 0.5::DOUBLE) * (360.0::DOUBLE / (pow(2, zoom) * 16)) - 180 + 175) / 10 + 0.5) AS INT) AS i FROM (SELECT zoom, unnest(range(CAST(16 * pow(2, zoom) AS BIGINT))) AS k FROM zz)),
rs AS (SELECT zoom, k, CAST(floor(((k + 0.5::DOUBLE) * (360.0::DOUBLE / (pow(2, zoom) * 16)) - 90 + 85) / 10 + 0.5) AS INT) AS j FROM (SELECT zoom, unnest(range(CAST(8 * pow(2, zoom) AS BIGINT))) AS k FROM zz)),
one AS (SELECT layer_id, min(t) AS t FROM cells GROUP BY layer_id)
SELECT c.layer_id, CAST(cs.zoom AS INT) AS zoom, CAST(rs.k // 16 AS INT) AS tile_row, CAST(cs.k // 16 AS INT) AS tile_col, CAST(cs.k % 16 AS INT) AS px, CAST(rs.k % 16 AS INT) AS py, c.value
FROM cells c JOIN one ON one.layer_id = c.layer_id AND one.t = c.t JOIN cs ON cs.i = c.i JOIN rs ON rs.j = c.j AND rs.zoom = cs.zoom WHERE c.z_index = 0""")
def ext16b(v):
    first = v.cells.groupBy("layer_id").agg(F.min("t").alias("t"))
    shown = v.cells.filter("z_index = 0").join(first, ["layer_id", "t"])
    return extract.tile_pyramid(shown, v.world_axes, WORLD, (1, 2, 3), 16).drop("t", "z_index")


@query("ext17_multi_series", ("cells",), """
WITH s AS (SELECT layer_id AS label, t, max(value) AS value FROM cells WHERE layer_id IN ('A', 'N') GROUP BY 1, 2)
SELECT label, t, value, min(value) OVER () AS low, max(value) OVER () AS high FROM s""")
def ext17(v):
    most = v.cells.groupBy("layer_id", "t").agg(F.max("value").alias("value"))
    return extract.multi_series({k: most.filter(F.col("layer_id") == k) for k in ("A", "N")})


@query("ext18_transect_segments", ("lines",), LINE_SQL + "SELECT line_id, seq, round(fraction * 200, 6) AS start, round(nf * 200, 6) AS \"end\" FROM (SELECT *, lead(fraction) OVER (PARTITION BY line_id ORDER BY seq) AS nf FROM control) WHERE nf IS NOT NULL")
def ext18(v):
    out = extract.transect_segments(coords.parse_linestring(v.lines), 200)
    return out.select("line_id", "seq", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


VEC1 = """
kd AS (SELECT *, CASE WHEN contains(title, 'eastward') THEN 'e' WHEN contains(title, 'northward') THEN 'n' END AS kind, CASE WHEN contains(title, 'eastward') THEN regexp_replace(title, 'eastward_', '') ELSE regexp_replace(title, 'northward_', '') END AS vector_key FROM layers),
vl AS (SELECT dataset_id, vector_key, arg_max(layer_id, layer_no) FILTER (kind = 'e') AS east_id, arg_max(layer_id, layer_no) FILTER (kind = 'n') AS north_id FROM kd WHERE kind IS NOT NULL GROUP BY 1, 2)"""


@query("vec1_find_vector_layers", ("layers",), f"WITH {VEC1} SELECT * FROM vl WHERE east_id IS NOT NULL AND north_id IS NOT NULL")
def vec1(v):
    return vectors.find_vector_layers(v.layers)


COMPONENTS = "cm AS (SELECT t, z_index, j, i, max(CASE WHEN layer_id = 'A' THEN value END) AS east, max(CASE WHEN layer_id = 'N' THEN value END) AS north FROM cells WHERE layer_id IN ('A', 'N') GROUP BY 1, 2, 3, 4)"


@query("vec2_magnitude", ("cells",), f"WITH {COMPONENTS} SELECT *, round(sqrt(east * east + north * north), 6) AS value FROM cm")
def vec2(v):
    return vectors.magnitude(vectors.components(v.cells, "A", "N")).withColumn("value", F.round("value", 6))


@query("vec3_direction_arrows", ("cells",), f"""WITH {COMPONENTS}, px AS (SELECT *, i * 4 AS px, (17 - j) * 4 AS py FROM cm)
SELECT t, z_index, px, py, round(atan2(north, east), 6) AS angle, CAST(floor(px + 10 * cos(atan2(north, east)) + 0.5) AS INT) AS end_x, CAST(floor(py - 10 * sin(atan2(north, east)) + 0.5) AS INT) AS end_y
FROM px WHERE px % 12 = 0 AND py % 12 = 0 AND east IS NOT NULL AND north IS NOT NULL""")
def vec3(v):
    shown = vectors.components(v.cells, "A", "N").withColumns({"px": F.col("i") * 4, "py": (17 - F.col("j")) * 4})
    return vectors.direction_arrows(shown, 10).select("t", "z_index", "px", "py", F.round("angle", 6).alias("angle"), "end_x", "end_y")


@query("vec4_combine_layers", ("layers",), f"""WITH {VEC1}
SELECT dataset_id, layer_id, title, 'scalar' AS kind, NULL AS east_id FROM layers UNION ALL
SELECT dataset_id, concat('vector_', vector_key), vector_key, 'vector', east_id FROM vl WHERE east_id IS NOT NULL AND north_id IS NOT NULL""")
def vec4(v):
    return vectors.combine_layers(v.layers, vectors.find_vector_layers(v.layers)).select("dataset_id", "layer_id", "title", "kind", "east_id")


