"""Queries of ranges, reports and usage (AGG), elevations (ELV), colours (COL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.operators import colour, elevation, extract, stats, vectors
from gridspark.plans.extract import COMPONENTS, PIXELS, SECTION, SPEED, WORLD, boxes, frames, path_sql, speed, transect_points
from gridspark.plans.coords import WORLD_I, WORLD_J
from gridspark.operators import coords
from gridspark.plans.registry import query


@query("agg1_find_min_max", ("cells",), "SELECT layer_id, t, min(value) AS vmin, max(value) AS vmax FROM cells GROUP BY 1, 2")
def agg1(v):
    return stats.find_min_max(v.cells, ["layer_id", "t"])


def views_with_layer(v):
    first = v.cells.groupBy("layer_id").agg(F.min("t").alias("t"))
    lettered = boxes(v).withColumn("layer_id", F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("width") * 0 + F.substring("grid_id", 2, 3).cast("int") % 3 + 1).cast("int")))
    return lettered.join(first, "layer_id").withColumn("z_index", F.lit(0))


@query("agg2_min_max_for_view", ("cells", "bboxes"), f"""WITH {PIXELS}, first AS (SELECT layer_id, min(t) AS t FROM cells GROUP BY 1),
rq AS (SELECT grid_id, CASE CAST(substr(grid_id, 2) AS INT) % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS layer_id FROM bboxes)
SELECT rq.grid_id, min(c.value) AS vmin, max(c.value) AS vmax FROM rq LEFT JOIN pm ON pm.grid_id = rq.grid_id JOIN first f ON f.layer_id = rq.layer_id
LEFT JOIN cells c ON c.layer_id = rq.layer_id AND c.t = f.t AND c.z_index = 0 AND c.j = pm.j AND c.i = pm.i GROUP BY rq.grid_id""")
def agg2(v):
    return stats.min_max_for_view(v.cells, v.world_axes, views_with_layer(v))


@query("agg2_min_max_for_view_vector", ("cells", "bboxes"), f"""WITH {PIXELS}, {SPEED}, first AS (SELECT min(t) AS t FROM cells)
SELECT pm.grid_id, round(min(c.value), 6) AS vmin, round(max(c.value), 6) AS vmax FROM pm CROSS JOIN first f LEFT JOIN vc c ON c.layer_id = 'speed' AND c.t = f.t AND c.z_index = 0 AND c.j = pm.j AND c.i = pm.i GROUP BY 1""")
def agg2b(v):
    first = v.cells.agg(F.min("t").alias("t")).select("t", F.lit(0).alias("z_index"), F.lit("speed").alias("layer_id"))
    found = stats.min_max_for_view(v.cells, v.world_axes, boxes(v).join(F.broadcast(first)), speed(v))  # one row
    return found.select("grid_id", F.round("vmin", 6).alias("vmin"), F.round("vmax", 6).alias("vmax"))


def world_layers(v):
    first = v.cells.groupBy("layer_id").agg(F.min("t").alias("t"), F.min("z_index").alias("z_index"))
    return first.select("*", F.lit(WORLD).alias("source_id"), F.lit(-180.0).alias("min_x"), F.lit(-90.0).alias("min_y"), F.lit(180.0).alias("max_x"), F.lit(90.0).alias("max_y"))


@query("agg3_estimate_value_range", ("cells",), """
WITH first AS (SELECT layer_id, min(t) AS t, min(z_index) AS z_index FROM cells GROUP BY 1)
SELECT f.layer_id, min(c.value) AS vmin, max(c.value) AS vmax FROM first f LEFT JOIN cells c ON c.layer_id = f.layer_id AND c.t = f.t AND c.z_index = f.z_index GROUP BY 1""")
def agg3(v):
    """The sample of 100 x 100 hits every cell of the 36 x 18 grid, so SQL takes them all."""
    return stats.estimate_value_range(v.cells, v.world_axes, world_layers(v))


@query("agg3_estimate_value_range_vector", ("cells",), f"""
WITH {SPEED}, first AS (SELECT layer_id, min(t) AS t, min(z_index) AS z_index FROM cells GROUP BY 1 UNION ALL SELECT 'speed', min(t), min(z_index) FROM cells WHERE layer_id IN ('A', 'N'))
SELECT f.layer_id, round(min(c.value), 6) AS vmin, round(max(c.value), 6) AS vmax FROM first f LEFT JOIN vc c ON c.layer_id = f.layer_id AND c.t = f.t AND c.z_index = f.z_index GROUP BY 1""")
def agg3b(v):
    """Scalar layers and the vector layer in one job; the range of a vector is that of both components' magnitude."""
    first = v.cells.filter("layer_id in ('A', 'N')").agg(F.min("t").alias("t"), F.min("z_index").alias("z_index")).withColumn("layer_id", F.lit("speed"))
    layers = world_layers(v)
    more = first.select("layer_id", "t", "z_index", *[F.lit(x).alias(c) for c, x in (("source_id", WORLD), ("min_x", -180.0), ("min_y", -90.0), ("max_x", 180.0), ("max_y", 90.0))])
    found = stats.estimate_value_range(v.cells, v.world_axes, layers.unionByName(more), pairs=speed(v))
    return found.select("layer_id", F.round("vmin", 6).alias("vmin"), F.round("vmax", 6).alias("vmax"))


RANGES = """rg AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS vmin, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN CAST(p_size AS DOUBLE) ELSE CAST(p_size + p_partkey % 64 AS DOUBLE) END AS vmax FROM part)"""


def ranges(v):
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    high = F.when(k % 7 == 0, size).otherwise((F.col("p_size") + k % 64).cast("double"))
    return v.table("part").select(k.alias("id"), F.when(k % 5 != 0, size).alias("vmin"), F.when(k % 5 != 0, high).alias("vmax"))


@query("agg4_default_colour_range", (), f"""WITH {RANGES}
SELECT id, round(CASE WHEN vmin IS NULL THEN -50 WHEN vmin = vmax THEN vmin ELSE vmin - 0.05::DOUBLE * (vmax - vmin) END, 6) AS vmin, round(CASE WHEN vmin IS NULL THEN 50 WHEN vmin = vmax THEN vmax + 1 ELSE vmax + 0.05::DOUBLE * (vmax - vmin) END, 6) AS vmax FROM rg""")
def agg4(v):
    return stats.default_colour_range(ranges(v)).select("id", F.round("vmin", 6).alias("vmin"), F.round("vmax", 6).alias("vmax"))


FRAMES = f"""{PIXELS}, fr AS (SELECT DISTINCT t FROM cells WHERE layer_id = 'A' AND z_index = 1),
fv AS (SELECT pm.grid_id, fr.t, pm.pixel, pm.col, pm.row, c.value FROM pm CROSS JOIN fr LEFT JOIN cells c ON c.layer_id = 'A' AND c.t = fr.t AND c.z_index = 1 AND c.j = pm.j AND c.i = pm.i),
fs AS (SELECT *, min(value) OVER (PARTITION BY grid_id) AS vmin, max(value) OVER (PARTITION BY grid_id) AS vmax FROM fv)"""


@query("agg5_auto_scale", ("cells", "bboxes"), f"WITH {FRAMES} SELECT grid_id, t, pixel, value, vmin, vmax FROM fs")
def agg5(v):
    return stats.auto_scale(extract.map_frames(v.cells, v.world_axes, boxes(v), frames(v)), ["grid_id"]).select("grid_id", "t", "pixel", "value", "vmin", "vmax")


@query("agg5_auto_scale_vector", ("cells",), f"""WITH {COMPONENTS}
SELECT t, z_index, j, i, min(east) OVER w AS x_min, max(east) OVER w AS x_max, round(min(sqrt(east * east + north * north)) OVER w, 6) AS vmin, round(max(sqrt(east * east + north * north)) OVER w, 6) AS vmax FROM cm WINDOW w AS (PARTITION BY z_index)""")
def agg5b(v):
    """The range by the eastward component alone, and by the magnitude, of an animation for each elevation."""
    both = vectors.components(v.cells, "A", "N")
    x = stats.auto_scale(both, ["z_index"], component="x").withColumnsRenamed({"vmin": "x_min", "vmax": "x_max"})
    out = stats.auto_scale(x, ["z_index"], component="magnitude")
    return out.select("t", "z_index", "j", "i", "x_min", "x_max", F.round("vmin", 6).alias("vmin"), F.round("vmax", 6).alias("vmax"))


@query("agg6_section_range", ("cells", "lines", "z_axis"), SECTION + "SELECT line_id, min(value) AS vmin, max(value) AS vmax FROM section GROUP BY line_id")
def agg6(v):
    return stats.section_range(extract.vertical_section(v.cells, v.z_axis, v.world_axes, transect_points(v)))


@query("agg7_layer_report", ("cells",), """
WITH n AS (SELECT layer_id, count(DISTINCT t) AS times, count(DISTINCT z_index) AS elevations, min(t) AS t, min(z_index) AS z_index FROM cells GROUP BY 1)
SELECT n.layer_id, concat('Layer ', n.layer_id) AS title, 'm/s' AS units, -180.0::DOUBLE AS min_x, -90.0::DOUBLE AS min_y, 180.0::DOUBLE AS max_x, 90.0::DOUBLE AS max_y, n.times, n.elevations, min(c.value) AS vmin, max(c.value) AS vmax
FROM n LEFT JOIN cells c ON c.layer_id = n.layer_id AND c.t = n.t AND c.z_index = n.z_index GROUP BY ALL""")
def agg7(v):
    layers = world_layers(v).drop("t", "z_index").withColumns({"title": F.concat(F.lit("Layer "), "layer_id"), "units": F.lit("m/s")})
    return stats.layer_report(v.cells, layers, v.world_axes)


@query("agg8_usage_by", ("usage_log",), """
SELECT client_referrer, count(*) AS requests, count(*) FILTER (used_cache) AS cached, count(*) FILTER (used_cache) * 100.0::DOUBLE / count(*) AS percent, CAST(row_number() OVER (ORDER BY count(*) DESC, client_referrer NULLS FIRST) AS INT) AS rank
FROM usage_log WHERE wms_operation = 'GetMap' GROUP BY 1""")
def agg8(v):
    return stats.ranked(stats.usage_by(v.usage_log, "client_referrer"), [], F.desc("requests"), F.col("client_referrer"))


@query("agg9_usage_totals", ("usage_log",), """
SELECT client_hostname, client_user_agent, client_referrer, CASE WHEN grouping(client_hostname) = 0 THEN 'client_hostname' WHEN grouping(client_user_agent) = 0 THEN 'client_user_agent' WHEN grouping(client_referrer) = 0 THEN 'client_referrer' ELSE 'total' END AS dimension,
       count(*) AS requests, count(*) FILTER (used_cache) AS cached
FROM usage_log WHERE wms_operation = 'GetMap' GROUP BY GROUPING SETS ((client_hostname), (client_user_agent), (client_referrer), ())""")
def agg9(v):
    return stats.usage_totals(v.usage_log)


@query("agg10_usage_entry_count", ("usage_log",), "SELECT count(*) AS entries FROM usage_log")
def agg10(v):
    return stats.usage_entry_count(v.usage_log)


@query("agg11_find_duplicate_ids", ("layers",), "SELECT dataset_id, title, count(*) AS n FROM layers GROUP BY 1, 2 HAVING count(*) > 1")
def agg11(v):
    return stats.find_duplicate_ids(v.layers, ["dataset_id", "title"])


@query("agg11_repeated_titles", ("layers",), "SELECT title, count(*) AS n FROM layers GROUP BY 1 HAVING count(*) > 1")
def agg11b(v):
    return stats.find_duplicate_ids(v.layers, ["title"])


@query("agg12_distinct_cells_sampled", ("lines",), path_sql("[100]") + f""",
mp AS (SELECT line_id, n, {WORLD_I.replace('x +', 'round(x, 9) +')} AS i, {WORLD_J.replace('y', 'round(y, 9)')} AS j FROM path)
SELECT line_id, n, count(DISTINCT CASE WHEN i IS NOT NULL AND j IS NOT NULL THEN i * 1000 + j END) + max(CASE WHEN i IS NULL OR j IS NULL THEN 1 ELSE 0 END) AS cells FROM mp GROUP BY 1, 2""")
def agg12(v):
    points = extract.points_on_path(coords.parse_linestring(v.lines), 100).withColumns({"grid_id": F.lit(WORLD), "x": F.round("x", 9), "y": F.round("y", 9)})
    return extract.distinct_cells_sampled(extract.point_map(v.world_axes, points), ("line_id", "n"))


@query("elv1_normalise_elevation", ("z_axis",), "SELECT layer_id, z_index, CASE WHEN positive OR pressure THEN z ELSE -z END AS z FROM z_axis")
def elv1(v):
    return elevation.normalise_elevation(v.z_axis).select("layer_id", "z_index", "z")


@query("elv2_default_elevation", ("z_axis",), "SELECT layer_id, CASE WHEN any_value(units) IN ('Pa', 'hPa') THEN max(z) ELSE arg_min(z, {'d': abs(z), 'k': z_index}) END AS z FROM z_axis GROUP BY layer_id")
def elv2(v):
    return elevation.default_elevation(v.z_axis)


ELEVATIONS = """rq AS (SELECT event_id AS request_id, CASE user_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'N' WHEN 2 THEN 'R' ELSE 'X' END AS layer_id,
CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '500' WHEN 2 THEN '-5' WHEN 3 THEN '499.997' WHEN 4 THEN '1/2' WHEN 5 THEN 'deep' WHEN 6 THEN '0' WHEN 7 THEN '20' ELSE '100' END AS elevation, CAST(event_id % 1500 AS DOUBLE) / 2 - 250 AS target FROM events)"""


def elevation_requests(v):
    k = F.col("event_id") % 9
    text = F.lit(None).cast("string")
    for n, s in enumerate(("500", "-5", "499.997", "1/2", "deep", "0", "20", "100"), 1):
        text = F.when(k == n, s).otherwise(text)
    layer = F.element_at(F.array(*map(F.lit, "ANRX")), (F.col("user_id") % 4 + 1).cast("int"))
    return v.table("events").select(F.col("event_id").alias("request_id"), layer.alias("layer_id"), text.alias("elevation"), ((F.col("event_id") % 1500).cast("double") / 2 - 250).alias("target"))


@query("elv3_match_elevation", ("z_axis",), f"""WITH {ELEVATIONS},
df AS (SELECT layer_id, CASE WHEN any_value(units) IN ('Pa', 'hPa') THEN max(z) ELSE arg_min(z, {{'d': abs(z), 'k': z_index}}) END AS z FROM z_axis GROUP BY layer_id),
wt AS (SELECT rq.*, df.layer_id IS NOT NULL AS known, CASE WHEN elevation IS NULL THEN df.z ELSE TRY_CAST(elevation AS DOUBLE) END AS wanted FROM rq LEFT JOIN df ON df.layer_id = rq.layer_id),
hit AS (SELECT w.request_id, min(z.z_index) AS z_index FROM wt w JOIN z_axis z ON z.layer_id = w.layer_id AND (z.z = w.wanted OR (w.wanted <> 0 AND abs((z.z - w.wanted) / w.wanted) < 1e-5)) GROUP BY 1)
SELECT w.request_id, w.layer_id, h.z_index, CASE WHEN NOT known THEN NULL WHEN elevation LIKE '%/%' OR elevation LIKE '%,%' THEN 'one elevation only' WHEN elevation IS NOT NULL AND wanted IS NULL THEN 'not a number' WHEN h.z_index IS NULL THEN 'no such elevation' END AS error
FROM wt w LEFT JOIN hit h ON h.request_id = w.request_id""")
def elv3(v):
    return elevation.match_elevation(elevation_requests(v), v.z_axis).select("request_id", "layer_id", "z_index", "error")


@query("elv4_nearest_elevation", ("z_axis",), f"""WITH {ELEVATIONS},
b AS (SELECT rq.request_id, arg_min(z.z_index, {{'d': abs(z.z - rq.target), 'k': z.z_index}}) AS z_index FROM rq JOIN z_axis z ON z.layer_id = rq.layer_id GROUP BY 1)
SELECT rq.request_id, rq.target, b.z_index, z.z FROM rq LEFT JOIN b ON b.request_id = rq.request_id LEFT JOIN z_axis z ON z.layer_id = rq.layer_id AND z.z_index = b.z_index""")
def elv4(v):
    return elevation.nearest_elevation(elevation_requests(v), v.z_axis).select("request_id", "target", "z_index", "z")


@query("elv5_display_elevation", ("z_axis",), """
SELECT layer_id, z_index, CASE WHEN positive THEN 'Height' WHEN pressure THEN 'Pressure' ELSE 'Depth' END AS label, NOT positive AS inverted, CASE WHEN NOT positive AND NOT pressure THEN -z ELSE z END AS display_z FROM z_axis""")
def elv5(v):
    return elevation.display_elevation(v.z_axis).select("layer_id", "z_index", "label", "inverted", "display_z")


@query("col1_colour_index", ("cells",), """
SELECT layer_id, t, z_index, j, i, CAST(CASE WHEN value < 10000 OR value > 60000 THEN 101 ELSE least(99, floor((value - 10000) / 50000 * 100)) END AS INT) AS idx,
       CAST(CASE WHEN value < 10000 OR value > 60000 THEN 51 ELSE least(49, floor(round((ln(value) - ln(10000)) / (ln(60000) - ln(10000)) * 50, 9))) END AS INT) AS log_idx FROM cells""")
def col1(v):
    low, high = F.lit(10000.0), F.lit(60000.0)
    return v.cells.select("layer_id", "t", "z_index", "j", "i", colour.colour_index(F.col("value"), low, high, 100).alias("idx"), colour.colour_index(F.col("value"), low, high, 50, log=True).alias("log_idx"))


def palette_files(v):
    """A palette text per nation: a comment and a colour per supplier, some bad lines."""
    k = F.col("s_suppkey")
    line = F.when(k % 13 == 0, "1 2").when(k % 2 == 0, F.concat_ws(" ", (k % 256).cast("string"), (k * 7 % 256).cast("string"), F.lit("200 extra"))).otherwise(F.concat_ws("  ", (k % 8 / 8).cast("string"), (k % 4 / 4).cast("string"), F.lit("1.0")))
    lines = v.table("supplier").groupBy(F.concat(F.lit("/palettes/Pal"), F.col("s_nationkey").cast("string"), F.lit(".pal")).alias("path")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(k.alias("k"), line.alias("s")))), lambda x: x["s"]), "\n").alias("value"))
    return lines.withColumn("value", F.concat(F.lit("# a comment\n\n"), "value"))


@query("col2_read_palettes", (), """
WITH l AS (SELECT s_suppkey AS k, concat('pal', CAST(s_nationkey AS STRING)) AS palette, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INT) AS seq FROM supplier)
SELECT palette, seq, CAST(CASE WHEN k % 13 = 0 THEN NULL WHEN k % 2 = 0 THEN k % 256 ELSE floor((k % 8) / 8 * 255 + 0.5) END AS INT) AS r, CAST(CASE WHEN k % 13 = 0 THEN NULL WHEN k % 2 = 0 THEN k * 7 % 256 ELSE floor((k % 4) / 4 * 255 + 0.5) END AS INT) AS g,
       CAST(CASE WHEN k % 13 = 0 THEN NULL WHEN k % 2 = 0 THEN 200 ELSE 255 END AS INT) AS b, CASE WHEN k % 13 = 0 THEN 'three numbers wanted' END AS error FROM l""")
def col2(v):
    return colour.read_palettes(palette_files(v))


def palettes(v):
    k = F.col("p_partkey")
    return v.table("part").select(F.concat(F.lit("p"), F.floor(k / 12).cast("string")).alias("palette"), (k % 12).cast("int").alias("seq"), (k * 31 % 256).cast("int").alias("r"), (k * 17 % 256).cast("int").alias("g"), (k * 5 % 256).cast("int").alias("b"))


@query("col3_resample_palette", (), """
WITH k AS (SELECT concat('p', CAST(CAST(floor(p_partkey / 12) AS INT) AS STRING)) AS palette, p_partkey % 12 AS seq, p_partkey * 31 % 256 AS r, p_partkey * 17 % 256 AS g, p_partkey * 5 % 256 AS b FROM part),
p AS (SELECT palette, (row_number() OVER w) - 1 AS i, count(*) OVER (PARTITION BY palette) AS size, r, g, b FROM k WINDOW w AS (PARTITION BY palette ORDER BY seq)),
f AS (SELECT *, CAST(CASE WHEN i = 0 THEN 0 WHEN i = size - 1 THEN 29 ELSE floor(30.0::DOUBLE * i / (size - 1) + 0.5) END AS INT) AS pos FROM p),
n AS (SELECT *, lead(pos) OVER w AS nx, lead(r) OVER w AS r2, lead(g) OVER w AS g2, lead(b) OVER w AS b2 FROM f WINDOW w AS (PARTITION BY palette ORDER BY i)),
j AS (SELECT *, unnest(range(pos + 1, nx)) AS j, CASE WHEN i = size - 2 THEN 30 ELSE nx END AS nd FROM n WHERE nx IS NOT NULL),
s AS (SELECT *, (j - pos)::DOUBLE / (nd - pos) AS s FROM j)
SELECT palette, pos AS idx, CAST(r AS INT) AS r, CAST(g AS INT) AS g, CAST(b AS INT) AS b FROM f
UNION ALL SELECT palette, CAST(j AS INT), CAST(floor(s * r2 + (1 - s) * r + 0.5) AS INT), CAST(floor(s * g2 + (1 - s) * g + 0.5) AS INT), CAST(floor(s * b2 + (1 - s) * b + 0.5) AS INT) FROM s""")
def col3(v):
    """More colours than a palette has."""
    return colour.resample_palette(palettes(v), 30)


@query("col4_colour_table", (), """
WITH p AS (SELECT concat('p', CAST(CAST(floor(p_partkey / 12) AS INT) AS STRING)) AS palette, CAST(p_partkey % 12 AS INT) AS idx, CAST(p_partkey * 31 % 256 AS INT) AS r, CAST(p_partkey * 17 % 256 AS INT) AS g, CAST(p_partkey * 5 % 256 AS INT) AS b FROM part)
SELECT palette, idx, r, g, b, 102 AS a FROM p UNION ALL SELECT DISTINCT palette, 12, 10, 20, 30, 0 FROM p UNION ALL SELECT DISTINCT palette, 13, 0, 0, 0, 102 FROM p""")
def col4(v):
    return colour.colour_table(palettes(v).withColumnRenamed("seq", "idx"), 12, 40, (10, 20, 30), True)


@query("col4_apply_palette", ("cells",), """
WITH c AS (SELECT *, CAST(CASE WHEN value < 10000 OR value > 60000 THEN 13 ELSE least(11, floor((value - 10000) / 50000 * 12)) END AS INT) AS idx FROM cells)
SELECT layer_id, t, z_index, j, i, idx, CAST(CASE WHEN idx = 13 THEN 0 ELSE (12 + idx) * 31 % 256 END AS INT) AS r, 255 AS a FROM c""")
def col4b(v):
    table = colour.colour_table(palettes(v).filter("palette = 'p1'").withColumnRenamed("seq", "idx"), 12)
    indexed = v.cells.withColumn("idx", colour.colour_index(F.col("value"), F.lit(10000.0), F.lit(60000.0), 12))
    return colour.apply_palette(indexed, table).select("layer_id", "t", "z_index", "j", "i", "idx", "r", "a")


@query("col5_scale_ticks", ("layers",), """
SELECT layer_id, vmin AS tick0, round(vmin + (vmax - vmin) / 4, 6) AS tick1, round(vmin + (vmax - vmin) / 2, 6) AS tick2, round(exp(ln(vmin) + (ln(vmax) - ln(vmin)) / 3), 6) AS log_third FROM layers""")
def col5(v):
    linear = colour.scale_ticks(v.layers).select("layer_id", F.round("tick0", 6).alias("tick0"), F.round("tick1", 6).alias("tick1"), F.round("tick2", 6).alias("tick2"))
    return linear.join(colour.scale_ticks(v.layers, log=True).select("layer_id", F.round("third1", 6).alias("log_third")), "layer_id")


@query("col6_render_frames", ("cells", "bboxes"), f"""WITH {FRAMES}
SELECT grid_id, t, col AS px, CAST(3 - row AS INT) AS py, CAST(CASE WHEN value IS NULL THEN 254 WHEN vmin = vmax THEN 0 ELSE least(253, floor(round((value - vmin) / (vmax - vmin) * 254, 9))) END AS INT) AS idx FROM fs""")
def col6(v):
    out = colour.render(v.cells, v.world_axes, boxes(v), frames(v), 4)
    return out.select("grid_id", "t", F.col("col").alias("px"), "py", "idx")


@query("col6_render_vectors", ("cells",), f"""WITH {COMPONENTS}, m AS (SELECT *, sqrt(east * east + north * north) AS value FROM cm)
SELECT t, z_index, i AS px, CAST(17 - j AS INT) AS py, CAST(CASE WHEN value IS NULL THEN 100 WHEN value < 20000 OR value > 120000 THEN 101 ELSE least(99, floor(round((value - 20000) / 100000 * 100, 9))) END AS INT) AS idx FROM m""")
def col6b(v):
    both = vectors.components(v.cells, "A", "N").withColumnRenamed("j", "row")
    return colour.render_frames(both, 18, 100, (20000.0, 120000.0)).select("t", "z_index", F.col("i").alias("px"), "py", "idx")


@query("col6_render_default_range", ("cells", "bboxes"), f"""WITH {FRAMES}
SELECT grid_id, t, col AS px, CAST(3 - row AS INT) AS py, CAST(CASE WHEN value IS NULL THEN 254 WHEN value < 20000 OR value > 90000 THEN 255 ELSE least(253, floor(round((value - 20000) / 70000 * 254, 9))) END AS INT) AS idx FROM fs""")
def col6c(v):
    """On the layer's default range from the catalogue."""
    catalogue = v.cells.select("layer_id").distinct().select("layer_id", F.when(F.col("layer_id") == "A", 20000.0).alias("vmin"), F.when(F.col("layer_id") == "A", 90000.0).alias("vmax"))
    out = colour.render_frames(extract.map_frames(v.cells, v.world_axes, boxes(v), frames(v)), 4, value_range=catalogue)
    return out.select("grid_id", "t", F.col("col").alias("px"), "py", "idx")
