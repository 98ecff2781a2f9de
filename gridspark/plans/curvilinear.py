"""Queries of curvilinear grids (CUR)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.operators import curvilinear
from gridspark.plans.registry import folder, query
from gridspark.sources import io


def c180(x: str) -> str:
    turned = f"(CASE WHEN ({x}) % 360 < 0 THEN ({x}) % 360 + 360 ELSE ({x}) % 360 END)"
    return f"(CASE WHEN {turned} > 180 THEN {turned} - 360 ELSE {turned} END)"


def near(ref: str, x: str) -> str:
    """Of a longitude and the same one 360 degrees on, the one nearer to ref."""
    own = c180(x)
    other = f"(CASE WHEN {ref} < 0 THEN {own} - 360 ELSE {own} + 360 END)"
    return f"(CASE WHEN abs({ref} - {own}) < abs({ref} - {other}) THEN {own} ELSE {other} END)"


CORNERS = f"""
cc AS (SELECT grid_id, i, j, {c180('lon')} AS lon, lat FROM curv_cells),
gs AS (SELECT grid_id, max(i) + 1 AS ni, max(j) + 1 AS nj FROM cc GROUP BY 1 HAVING max(i) >= 2 AND max(j) >= 2),
ci AS (SELECT DISTINCT c.grid_id, c.i + u.a AS ci, c.j + u.b AS cj FROM cc c, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS u(a, b)),
k1 AS (SELECT gs.grid_id, gs.ni, gs.nj, ci.ci, ci.cj, (a.lon + {near('a.lon', 'b.lon')} + {near('a.lon', 'c.lon')} + {near('a.lon', 'd.lon')}) / 4 AS lon, (a.lat + b.lat + c.lat + d.lat) / 4 AS lat
       FROM gs JOIN ci ON ci.grid_id = gs.grid_id AND ci.ci BETWEEN 1 AND gs.ni - 1 AND ci.cj BETWEEN 1 AND gs.nj - 1
       LEFT JOIN cc a ON a.grid_id = ci.grid_id AND a.i = ci.ci - 1 AND a.j = ci.cj - 1 LEFT JOIN cc b ON b.grid_id = ci.grid_id AND b.i = ci.ci AND b.j = ci.cj - 1
       LEFT JOIN cc c ON c.grid_id = ci.grid_id AND c.i = ci.ci - 1 AND c.j = ci.cj LEFT JOIN cc d ON d.grid_id = ci.grid_id AND d.i = ci.ci AND d.j = ci.cj),
k2 AS (SELECT * FROM k1 UNION ALL SELECT a.grid_id, a.ni, a.nj, 0, a.cj, 2 * a.lon - b.lon, 2 * a.lat - b.lat FROM k1 a LEFT JOIN k1 b ON b.grid_id = a.grid_id AND b.cj = a.cj AND b.ci = 2 WHERE a.ci = 1
       UNION ALL SELECT a.grid_id, a.ni, a.nj, a.ni, a.cj, 2 * a.lon - b.lon, 2 * a.lat - b.lat FROM k1 a LEFT JOIN k1 b ON b.grid_id = a.grid_id AND b.cj = a.cj AND b.ci = a.ni - 2 WHERE a.ci = a.ni - 1),
kk AS (SELECT grid_id, ci, cj, lon, lat FROM k2 UNION ALL SELECT a.grid_id, a.ci, 0, 2 * a.lon - b.lon, 2 * a.lat - b.lat FROM k2 a LEFT JOIN k2 b ON b.grid_id = a.grid_id AND b.ci = a.ci AND b.cj = 2 WHERE a.cj = 1
       UNION ALL SELECT a.grid_id, a.ci, a.nj, 2 * a.lon - b.lon, 2 * a.lat - b.lat FROM k2 a LEFT JOIN k2 b ON b.grid_id = a.grid_id AND b.ci = a.ci AND b.cj = a.nj - 2 WHERE a.cj = a.nj - 1)"""

POLYGONS = CORNERS + f""",
pg AS (SELECT cc.grid_id, cc.i, cc.j, cc.lon, cc.lat, {near('cc.lon', 'p.lon')} AS x0, {near('cc.lon', 'q.lon')} AS x1, {near('cc.lon', 'r.lon')} AS x2, {near('cc.lon', 's.lon')} AS x3, p.lat AS y0, q.lat AS y1, r.lat AS y2, s.lat AS y3
       FROM cc JOIN kk p ON p.grid_id = cc.grid_id AND p.ci = cc.i AND p.cj = cc.j JOIN kk q ON q.grid_id = cc.grid_id AND q.ci = cc.i + 1 AND q.cj = cc.j
       JOIN kk r ON r.grid_id = cc.grid_id AND r.ci = cc.i + 1 AND r.cj = cc.j + 1 JOIN kk s ON s.grid_id = cc.grid_id AND s.ci = cc.i AND s.cj = cc.j + 1)"""

_SQ = "(pow(x{0} - x{1}, 2) + pow(y{0} - y{1}, 2))"
sq = lambda a, b: _SQ.format(a, b)
TERM = f"({sq(1, 2)} + {sq(3, 0)} - {sq(0, 1)} - {sq(2, 3)})"
AREAS = POLYGONS + f""",
sqr AS (SELECT *, 4 * {sq(0, 2)} * {sq(1, 3)} - {TERM} * {TERM} AS s FROM pg),
ar AS (SELECT *, CASE WHEN s >= 0 THEN sqrt(s) / 4 END AS area FROM sqr)"""


@query("cur1_curv_corners", ("curv_cells",), f"WITH {CORNERS} SELECT grid_id, ci, cj, round(lon, 9) AS lon, round(lat, 9) AS lat FROM kk")
def cur1(v):
    return curvilinear.curv_corners(v.curv_cells).withColumns({"lon": F.round("lon", 9), "lat": F.round("lat", 9)})


@query("cur2_curv_cell_polygons", ("curv_cells",), f"WITH {POLYGONS} SELECT grid_id, i, j, round(x0, 9) AS x0, round(y0, 9) AS y0, round(x2, 9) AS x2, round(y2, 9) AS y2, CASE WHEN x0 + x1 + x2 + x3 IS NOT NULL THEN round(least(x0, x1, x2, x3), 9) END AS min_x, CASE WHEN y0 + y1 + y2 + y3 IS NOT NULL AND lon IS NOT NULL THEN round(greatest(y0, y1, y2, y3), 9) END AS max_y FROM pg")
def cur2(v):
    out = curvilinear.curv_cell_polygons(v.curv_cells)
    return out.select("grid_id", "i", "j", *[F.round(c, 9).alias(c) for c in ("x0", "y0", "x2", "y2", "min_x")], F.round("max_y", 9).alias("max_y"))


@query("cur3_curv_cell_area", ("curv_cells",), f"WITH {AREAS} SELECT grid_id, i, j, round(area, 6) AS area FROM ar")
def cur3(v):
    return curvilinear.curv_cell_area(curvilinear.curv_cell_polygons(v.curv_cells)).select("grid_id", "i", "j", F.round("area", 6).alias("area"))


@query("cur3_curv_mean_area", ("curv_cells",), f"WITH {AREAS} SELECT grid_id, round(avg(area), 6) AS mean_area FROM ar GROUP BY 1")
def cur3b(v):
    return curvilinear.curv_mean_area(curvilinear.curv_cell_polygons(v.curv_cells)).withColumn("mean_area", F.round("mean_area", 6))


@query("cur4_curv_bbox", ("curv_cells",), f"SELECT grid_id, min({c180('lon')}) AS west, max({c180('lon')}) AS east, min(lat) AS south, max(lat) AS north FROM curv_cells WHERE lon IS NOT NULL AND lat IS NOT NULL GROUP BY 1")
def cur4(v):
    return curvilinear.curv_bbox(v.curv_cells)


@query("cur5_curv_neighbours", ("curv_cells",), """
SELECT a.grid_id, a.i, a.j, b.i AS ni, b.j AS nj, CASE WHEN a.i = b.i OR a.j = b.j THEN 'edge' ELSE 'corner' END AS neighbour FROM curv_cells a JOIN curv_cells b ON b.grid_id = a.grid_id AND b.i BETWEEN a.i - 1 AND a.i + 1 AND b.j BETWEEN a.j - 1 AND a.j + 1 AND NOT (a.i = b.i AND a.j = b.j)""")
def cur5(v):
    return curvilinear.curv_neighbours(v.curv_cells)


@query("cur6_curv_containing", ("curv_cells", "curv_points"), f"""WITH {POLYGONS},
bx AS (SELECT *, least(x0, x1, x2, x3) AS bx0, greatest(x0, x1, x2, x3) AS bx1, least(y0, y1, y2, y3) AS by0, greatest(y0, y1, y2, y3) AS by1 FROM pg WHERE x0 + x1 + x2 + x3 + y0 + y1 + y2 + y3 IS NOT NULL),
ht AS (SELECT p.point_id, b.i, b.j, {' + '.join(f"CASE WHEN (b.y{a} > p.lat) <> (b.y{b} > p.lat) AND p.lon < (b.x{b} - b.x{a}) * ((p.lat - b.y{a}) / (b.y{b} - b.y{a})) + b.x{a} THEN 1 ELSE 0 END" for a, b in ((0, 1), (1, 2), (2, 3), (3, 0)))} AS n
       FROM curv_points p JOIN bx b ON b.grid_id = p.grid_id AND p.lat BETWEEN b.by0 AND b.by1 AND p.lon BETWEEN b.bx0 AND b.bx1),
best AS (SELECT point_id, min(j * 100000 + i) AS k FROM ht WHERE n % 2 = 1 GROUP BY 1)
SELECT p.point_id, CAST(k % 100000 AS INT) AS i, CAST(k // 100000 AS INT) AS j FROM curv_points p LEFT JOIN best ON best.point_id = p.point_id""")
def cur6(v):
    """The index is written to the shared folder, as it would be kept, and looked up there."""
    out = folder(v.spark)
    io.write_tile_index(curvilinear.curv_tile_index(curvilinear.curv_cell_polygons(v.curv_cells)), out)
    index = v.spark.read.schema("i int, j int, tx long, ty long, centre double, " + ", ".join(f"x{k} double, y{k} double" for k in range(4)) + ", grid_id string, level int").parquet(out)
    return curvilinear.curv_containing(v.curv_points, index).select("point_id", "i", "j")


REACH = 1.5


@query("cur7_curv_nearest", ("curv_cells", "curv_points"), f"""
WITH d AS (SELECT p.point_id, c.i, c.j, pow(p.lon - c.lon, 2) + pow(p.lat - c.lat, 2) AS d2, abs(p.lon - c.lon) <= {REACH} AND abs(p.lat - c.lat) <= {REACH} AS close
           FROM curv_points p JOIN curv_cells c ON c.grid_id = p.grid_id AND abs(p.lon - c.lon) <= 3 AND abs(p.lat - c.lat) <= 3),
b AS (SELECT point_id, arg_min(i, {{'d': d2, 'j': j, 'i': i}}) AS i, arg_min(j, {{'d': d2, 'j': j, 'i': i}}) AS j, bool_or(close) AS close FROM d GROUP BY 1)
SELECT p.point_id, CASE WHEN b.close THEN b.i END AS i, CASE WHEN b.close THEN b.j END AS j FROM curv_points p LEFT JOIN b ON b.point_id = p.point_id""")
def cur7(v):
    cells = v.curv_cells
    reach = cells.select("grid_id").distinct().withColumn("max_distance", F.lit(REACH))
    reach = reach.unionByName(v.curv_points.select("grid_id").distinct().join(reach.select("grid_id"), "grid_id", "left_anti").withColumn("max_distance", F.lit(REACH)))
    return curvilinear.curv_nearest(v.curv_points, cells, reach).select("point_id", "i", "j")


@query("cur8_curv_range_query", ("curv_cells", "views_bbox"), """
SELECT b.view_id AS box_id, c.i, c.j FROM views_bbox b JOIN curv_cells c ON c.grid_id = 'g0' AND c.lon BETWEEN b.min_x AND b.max_x AND c.lat BETWEEN b.min_y AND b.max_y""")
def cur8(v):
    return curvilinear.curv_range_query(v.views_bbox.withColumnRenamed("view_id", "box_id").withColumn("grid_id", F.lit("g0")), v.curv_cells)
