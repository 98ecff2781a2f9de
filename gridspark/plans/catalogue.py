"""Queries of the catalogue and request tables (CAT), sources and sinks (SRC, SNK), and streams (STR)."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridspark.operators import catalogue, coords, extract
from gridspark.plans.coords import WORLD_I, WORLD_J
from gridspark.plans.extract import TRANSECT, WORLD, transect_points
from gridspark.plans.registry import folder, query
from gridspark.plans.timeaxis import TIME_RANGES
from gridspark.sources import io
from gridspark.streaming import usage

OVERRIDES = """ov AS (SELECT dataset_id, layer_id, CASE WHEN layer_no % 2 = 0 THEN concat('Title ', layer_id) END AS title, CASE WHEN layer_no % 3 = 0 THEN CAST(0 AS DOUBLE) END AS vmin, CASE WHEN layer_no % 3 = 0 THEN CAST(9 AS DOUBLE) END AS vmax, 'redblue' AS palette, CAST(layer_no % 100 AS INT) AS bands FROM layers WHERE layer_no % 5 = 0)"""


def overrides(v):
    n = F.col("layer_no")
    return v.layers.filter(n % 5 == 0).select("dataset_id", "layer_id", F.when(n % 2 == 0, F.concat(F.lit("Title "), "layer_id")).alias("title"), F.when(n % 3 == 0, 0.0).alias("vmin"), F.when(n % 3 == 0, 9.0).alias("vmax"), F.lit("redblue").alias("palette"), (n % 100).cast("int").alias("bands"))


@query("cat1_apply_overrides", ("layers",), f"""WITH {OVERRIDES}
SELECT l.dataset_id, l.layer_id, coalesce(o.title, l.title) AS title, round(CASE WHEN o.vmin IS NOT NULL THEN o.vmin WHEN l.layer_no % 7 = 0 THEN -50 WHEN l.vmin = l.vmax THEN l.vmin ELSE l.vmin - 0.05::DOUBLE * (l.vmax - l.vmin) END, 6) AS vmin,
       round(CASE WHEN o.vmax IS NOT NULL THEN o.vmax WHEN l.layer_no % 7 = 0 THEN 50 WHEN l.vmin = l.vmax THEN l.vmax + 1 ELSE l.vmax + 0.05::DOUBLE * (l.vmax - l.vmin) END, 6) AS vmax, coalesce(o.palette, 'rainbow') AS palette, coalesce(o.bands, 254) AS bands
FROM layers l LEFT JOIN ov o ON o.dataset_id = l.dataset_id AND o.layer_id = l.layer_id""")
def cat1(v):
    gap = F.col("layer_no") % 7 == 0
    layers = v.layers.withColumns({"vmin": F.when(~gap, F.col("vmin")), "vmax": F.when(~gap, F.col("vmax"))})
    return catalogue.apply_overrides(layers, overrides(v)).select("dataset_id", "layer_id", "title", F.round("vmin", 6).alias("vmin"), F.round("vmax", 6).alias("vmax"), "palette", "bands")


@query("cat2_variable_title", (), """
SELECT p_partkey AS id, coalesce(CASE WHEN p_partkey % 3 = 0 AND trim(p_name) <> '' THEN p_name END, CASE WHEN p_partkey % 2 = 0 AND trim(p_type) <> '' THEN p_type END, CAST(p_partkey AS STRING)) AS title FROM part""")
def cat2(v):
    k = F.col("p_partkey")
    df = v.table("part").select(k.alias("key"), k.cast("string").alias("id"), F.when(k % 3 == 0, F.col("p_name")).otherwise("  ").alias("standard_name"), F.when(k % 2 == 0, F.col("p_type")).alias("long_name"))
    return df.select(F.col("key").alias("id"), catalogue.variable_title(df).alias("title"))


@query("cat3_layer_name", ("layers",), """
WITH n AS (SELECT layer_no, CASE layer_no % 4 WHEN 0 THEN concat('/', layer_id) WHEN 1 THEN layer_id ELSE concat('group/', dataset_id, '/', layer_id) END AS name, layer_id, dataset_id FROM layers)
SELECT layer_no, name, CASE WHEN layer_no % 4 >= 2 THEN concat('group/', dataset_id) END AS dataset, CASE WHEN layer_no % 4 >= 2 THEN layer_id END AS layer FROM n""")
def cat3(v):
    k = F.col("layer_no") % 4
    name = F.when(k == 0, F.concat(F.lit("/"), "layer_id")).when(k == 1, F.col("layer_id")).otherwise(catalogue.layer_name(F.concat(F.lit("group/"), "dataset_id"), F.col("layer_id")))
    named = v.layers.select("layer_no", name.alias("name"))
    dataset, layer = catalogue.split_layer_name(F.col("name"))
    return named.select("layer_no", "name", dataset.alias("dataset"), layer.alias("layer"))


NAMED = "rq AS (SELECT event_id AS request_id, concat('ds', CAST(user_id % 20 AS STRING), '/v', CAST(event_id % 300 AS STRING)) AS layer_name, concat('ds', CAST(user_id % 20 AS STRING)) AS d, concat('v', CAST(event_id % 300 AS STRING)) AS l FROM events)"


def named(v):
    name = F.concat(F.lit("ds"), (F.col("user_id") % 20).cast("string"), F.lit("/v"), (F.col("event_id") % 300).cast("string"))
    return v.table("events").select(F.col("event_id").alias("request_id"), name.alias("layer_name"))


@query("cat4_resolve_layers", ("layers",), f"WITH {NAMED} SELECT rq.request_id, layers.title FROM rq JOIN layers ON dataset_id = d AND layer_id = l")
def cat4(v):
    return catalogue.resolve_layers(named(v), v.layers).select("request_id", "title")


@query("cat4_unknown_layers", ("layers",), f"WITH {NAMED} SELECT rq.request_id, rq.layer_name FROM rq ANTI JOIN layers ON dataset_id = d AND layer_id = l")
def cat4b(v):
    return catalogue.unknown_layers(named(v), v.layers).select("request_id", "layer_name")


READY = "rd AS (SELECT l.* FROM layers l SEMI JOIN datasets d ON d.dataset_id = l.dataset_id AND NOT d.disabled AND d.state IN ('READY', 'UPDATING'))"


@query("cat5_ready_layers", ("layers", "datasets"), f"WITH {READY} SELECT dataset_id, layer_id, title FROM rd")
def cat5(v):
    return catalogue.ready_layers(v.layers, v.datasets).select("dataset_id", "layer_id", "title")


def shown_layers(v):
    """Layers with one of the three axes and a box each."""
    letter = F.element_at(F.array(*map(F.lit, "ANR")), (F.col("layer_no") % 3 + 1).cast("int"))
    n = F.col("layer_no").cast("double")
    return v.layers.select("*", letter.alias("axis"), (-n).alias("west"), n.alias("east"), (-n / 2).alias("south"), (n / 2).alias("north"))


@query("cat6_capabilities_table", ("layers", "datasets", "z_axis", "cells"), f"""WITH {READY},
z AS (SELECT layer_id, string_agg(CAST(z AS STRING), ',' ORDER BY z_index) AS elevations, CASE WHEN any_value(units) IN ('Pa', 'hPa') THEN max(z) ELSE arg_min(z, {{'d': abs(z), 'k': z_index}}) END AS default_elevation FROM z_axis GROUP BY 1),
ts AS (SELECT DISTINCT layer_id, t FROM cells),
tt AS (SELECT layer_id, string_agg(strftime(t, '%Y-%m-%d') || 'T00:00:00.000Z', ',' ORDER BY t) AS times, strftime(coalesce(max(t) FILTER (t <= DATE '1996-06-15'), min(t)), '%Y-%m-%d') || 'T00:00:00.000Z' AS default_time FROM ts GROUP BY 1),
ax AS (SELECT *, CASE layer_no % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS axis FROM rd)
SELECT concat(ax.dataset_id, '/', ax.axis) AS name, ax.title, CAST(-layer_no AS DOUBLE) AS west, CAST(layer_no AS DOUBLE) AS east, -layer_no / 2 AS south, layer_no / 2 AS north, z.elevations, z.default_elevation, tt.times, tt.default_time
FROM ax LEFT JOIN z ON z.layer_id = ax.axis LEFT JOIN tt ON tt.layer_id = ax.axis""")
def cat6(v):
    steps = v.cells.select("layer_id", "t").distinct()
    layers = shown_layers(v).withColumn("layer_id", F.col("axis"))
    return catalogue.capabilities_table(layers, v.datasets, v.z_axis, steps, "1996-06-15", verbose=True)


@query("cat6_compressed_times", ("cells", "z_axis"), "WITH RECURSIVE " + TIME_RANGES.replace("{steps}", "(SELECT DISTINCT layer_id, t FROM cells) AS s").replace("SELECT layer_id, string_agg", "SELECT concat('ds2/', layer_id) AS name, string_agg"))
def cat6c(v):
    """The time strings of the capabilities in their short form."""
    steps = v.cells.select("layer_id", "t").distinct()
    layers = steps.select("layer_id").distinct().select(F.lit("ds2").alias("dataset_id"), "layer_id", F.lit("title").alias("title"), *[F.lit(0.0).alias(k) for k in ("west", "east", "south", "north")])
    datasets = v.datasets.filter("dataset_id = 'ds2'").withColumns({"disabled": F.lit(False), "state": F.lit("READY")})
    return catalogue.capabilities_table(layers, datasets, v.z_axis, steps, "1996-06-15").select("name", "times")


@query("cat6_style_rows", ("layers",), """
WITH p AS (SELECT DISTINCT concat('pal', CAST(n_regionkey AS STRING)) AS palette FROM nation), s AS (SELECT 'boxfill' AS style UNION ALL SELECT 'vector')
SELECT dataset_id, layer_id, concat(s.style, '/', p.palette) AS style FROM layers CROSS JOIN s CROSS JOIN p WHERE s.style = 'boxfill' OR layers.layer_no % 3 = 0""")
def cat6b(v):
    palettes = v.table("nation").select(F.concat(F.lit("pal"), F.col("n_regionkey").cast("string")).alias("palette"))
    return catalogue.style_rows(v.layers, palettes, F.col("layer_no") % 3 == 0)


@query("cat7_layer_details", ("z_axis", "cells"), """
WITH s AS (SELECT DISTINCT layer_id, t FROM cells),
d AS (SELECT layer_id, string_agg(CAST(year(t) AS VARCHAR) || '/' || CAST(month(t) - 1 AS VARCHAR) || '/' || CAST(day(t) AS VARCHAR), ',' ORDER BY t) AS days,
             strftime(arg_min(t, {'d': abs(epoch_us(CAST(t AS TIMESTAMP)) - epoch_us(TIMESTAMP '1995-03-01')), 't': t}), '%Y-%m-%d') || 'T00:00:00.000Z' AS nearest FROM s GROUP BY 1),
z AS (SELECT layer_id, any_value(units) AS z_units, bool_and(positive) AS z_positive, string_agg(CAST(z AS STRING), ',' ORDER BY z_index) AS z_values FROM z_axis GROUP BY 1),
m AS (SELECT layer_id, CAST(min(i) AS DOUBLE) AS west, CAST(min(j) AS DOUBLE) AS south, CAST(max(i) AS DOUBLE) AS east, CAST(max(j) AS DOUBLE) AS north, min(value) AS vmin, max(value) AS vmax, CAST(max(i) + max(j) AS INT) AS bands FROM cells GROUP BY 1)
SELECT layer_id, CASE layer_id WHEN 'A' THEN 'm/s' ELSE 'K' END AS units, west, south, east, north, vmin, vmax, bands, CASE layer_id WHEN 'N' THEN 'vector,boxfill' ELSE 'boxfill' END AS styles, z_units, z_positive, z_values, days, nearest,
       CASE layer_id WHEN 'R' THEN '360_day' ELSE 'ISO8601' END AS time_units, (SELECT string_agg(p, ',' ORDER BY p) FROM (SELECT DISTINCT 'pal' || n_regionkey AS p FROM nation)) AS palettes, lower(layer_id) || 'bow' AS palette, layer_id = 'A' AS log
FROM m JOIN z USING (layer_id) JOIN d USING (layer_id)""")
def cat7(v):
    """The whole JSON record, read back and taken apart."""
    steps, k = v.cells.select("layer_id", "t").distinct(), F.col("layer_id")
    place = {n: f(c).cast("double").alias(n) for n, f, c in (("west", F.min, "i"), ("south", F.min, "j"), ("east", F.max, "i"), ("north", F.max, "j"), ("vmin", F.min, "value"), ("vmax", F.max, "value"))}
    layers = v.cells.groupBy("layer_id").agg(*place.values(), (F.max("i") + F.max("j")).cast("int").alias("bands"))
    layers = layers.withColumns({"units": F.when(k == "A", "m/s").otherwise("K"), "vector": k == "N", "calendar": F.when(k == "R", "360_day"), "palette": F.concat(F.lower(k), F.lit("bow")), "log": k == "A"})
    palettes = v.table("nation").select(F.concat(F.lit("pal"), F.col("n_regionkey").cast("string")).alias("palette"))
    record = "units string, bbox array<double>, scaleRange array<double>, numColorBands int, supportedStyles array<string>, zaxis struct<units:string,positive:boolean,values:array<double>>, datesWithData map<string,map<string,array<int>>>, nearestTimeIso string, timeAxisUnits string, palettes array<string>, defaultPalette string, logScaling boolean"
    out = catalogue.layer_details(layers, v.z_axis, steps, palettes, "1995-03-01").withColumn("d", F.from_json("details", record))
    months = lambda y: F.transform(F.map_entries(y["value"]), lambda m: F.transform(m["value"], lambda d: F.struct(y["key"].cast("int").alias("y"), m["key"].cast("int").alias("m"), d.alias("d"))))
    days = F.sort_array(F.flatten(F.flatten(F.transform(F.map_entries("d.datesWithData"), months))))
    text = F.array_join(F.transform(days, lambda d: F.concat_ws("/", *[d[c].cast("string") for c in "ymd"])), ",")
    box = [F.col("d.bbox")[n].alias(c) for n, c in enumerate(("west", "south", "east", "north"))] + [F.col("d.scaleRange")[n].alias(c) for n, c in enumerate(("vmin", "vmax"))]
    levels = F.array_join(F.transform("d.zaxis.values", lambda z: z.cast("string")), ",")
    return out.select("layer_id", "d.units", *box, F.col("d.numColorBands").alias("bands"), F.array_join("d.supportedStyles", ",").alias("styles"), F.col("d.zaxis.units").alias("z_units"), F.col("d.zaxis.positive").alias("z_positive"), levels.alias("z_values"), text.alias("days"), F.col("d.nearestTimeIso").alias("nearest"), F.col("d.timeAxisUnits").alias("time_units"), F.array_join("d.palettes", ",").alias("palettes"), F.col("d.defaultPalette").alias("palette"), F.col("d.logScaling").alias("log"))


@query("cat8_parse_request_params", ("map_requests",), """
WITH q AS (SELECT request_id, split_part(url, '?', 2) AS q FROM map_requests),
p AS (SELECT request_id, unnest(string_split(q, '&')) AS p FROM q)
SELECT request_id, lower(trim(url_decode(split_part(p, '=', 1)))) AS name, trim(url_decode(substr(p, strpos(p, '=') + 1))) AS value FROM p""")
def cat8(v):
    return catalogue.parse_request_params(v.map_requests).select("request_id", F.explode("params").alias("name", "value"))


@query("cat9_parse_map_requests", ("map_requests",), """
WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 11 = 0 THEN 'bbox: minimum not below maximum' WHEN event_id % 4 = 3 THEN 'bad colorscalerange' END AS error FROM events)
SELECT event_id AS request_id, error, CASE WHEN error IS NULL THEN concat('ds1/', CASE user_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END) END AS layer, CASE WHEN error IS NULL THEN 'CRS:84' END AS crs,
       CAST(CASE WHEN error IS NULL THEN CASE WHEN event_id % 2 = 0 THEN -20 ELSE -40 END END AS DOUBLE) AS min_x, CAST(CASE WHEN error IS NULL THEN CASE WHEN event_id % 2 = 0 THEN 60 ELSE 40 END END AS DOUBLE) AS max_x,
       CAST(CASE WHEN error IS NULL THEN event_id % 512 + 1 END AS INT) AS width, CAST(CASE WHEN error IS NULL THEN 256 END AS INT) AS height, CASE WHEN error IS NULL THEN CASE event_id % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'default' ELSE 'given' END END AS range_kind,
       CAST(CASE WHEN error IS NULL AND event_id % 4 = 2 THEN -5 END AS DOUBLE) AS vmin, CAST(CASE WHEN error IS NULL THEN least(event_id % 400, 254) END AS INT) AS bands, CAST(CASE WHEN error IS NULL THEN 16777215 END AS INT) AS background FROM e""")
def cat9(v):
    out = catalogue.parse_map_requests(catalogue.parse_request_params(v.map_requests))
    return out.select("request_id", "error", "layer", "crs", "min_x", "max_x", "width", "height", "range_kind", "vmin", "bands", "background")


@query("cat10_parse_colour_range", (), """
WITH t AS (SELECT event_id, user_id, event_id % 6 AS k FROM events)
SELECT event_id, CAST(CASE k WHEN 0 THEN user_id WHEN 1 THEN user_id + 0.5 WHEN 2 THEN 1.5 WHEN 3 THEN 9 END AS DOUBLE) AS vmin, CAST(CASE k WHEN 0 THEN greatest(user_id, 50) WHEN 1 THEN greatest(user_id + 0.5, 20.25) WHEN 2 THEN 7.25 WHEN 3 THEN 9 END AS DOUBLE) AS vmax FROM t""")
def cat10(v):
    u, k = F.col("user_id").cast("string"), F.col("event_id") % 6
    text = F.when(k == 0, F.concat(u, F.lit(",50"))).when(k == 1, F.concat(u, F.lit(",5 20.25"))).when(k == 2, "1,5,7,25").when(k == 3, " 9 4 ").when(k == 4, "one")
    return catalogue.parse_colour_range(v.table("events").select("event_id", text.alias("text"))).select("event_id", "vmin", "vmax")


_GIVEN = {
    "wms_operation": "'GetMap'", "wms_version": "CASE WHEN event_id % 2 = 0 THEN '1.3.0' ELSE '1.1.1' END", "exception_message": "error", "crs": "CASE WHEN error IS NULL THEN 'CRS:84' END",
    "bbox_minx": "CASE WHEN error IS NULL THEN CASE WHEN event_id % 2 = 0 THEN -20 ELSE -40 END END", "bbox_miny": "CASE WHEN error IS NULL THEN CASE WHEN event_id % 2 = 0 THEN -40 ELSE -20 END END",
    "bbox_maxx": "CASE WHEN error IS NULL THEN CASE WHEN event_id % 2 = 0 THEN 60 ELSE 40 END END", "bbox_maxy": "CASE WHEN error IS NULL THEN CASE WHEN event_id % 2 = 0 THEN 40 ELSE 60 END END",
    "image_width": "CASE WHEN error IS NULL THEN event_id % 512 + 1 END", "image_height": "CASE WHEN error IS NULL THEN 256 END", "layer": "CASE WHEN error IS NULL THEN concat('ds1/', letter) END", "dataset_id": "CASE WHEN error IS NULL THEN 'ds1' END",
    "variable_id": "CASE WHEN error IS NULL THEN letter END", "style_str": "CASE WHEN error IS NULL THEN '' END", "output_format": "CASE WHEN error IS NULL THEN 'image/png' END", "transparent": "CASE WHEN error IS NULL THEN false END", "background_color": "CASE WHEN error IS NULL THEN '255,255,255' END"}
_USAGE = [c.split() for c in catalogue.USAGE.replace("\n", " ").split(",")]
_ENTRIES = """e AS (SELECT event_id, user_id, CASE user_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS letter, CASE WHEN event_id % 11 = 0 THEN 'bbox: minimum not below maximum' WHEN event_id % 4 = 3 THEN 'bad colorscalerange' END AS error FROM events)"""
_ENTRY_SQL = f"WITH {_ENTRIES} SELECT " + ", ".join(f"CAST({_GIVEN.get(name, 'NULL')} AS {kind}) AS {name}" for name, kind in _USAGE) + " FROM e"


def _parsed(requests):
    version = F.try_element_at("params", F.lit("version"))
    return catalogue.parse_map_requests(catalogue.parse_request_params(requests)).withColumns({"wms_operation": F.lit("GetMap"), "version": version})


@query("cat11_usage_entries", ("map_requests",), _ENTRY_SQL)
def cat11(v):
    return catalogue.usage_entries(_parsed(v.map_requests))


# --- sources and sinks: each writes the tables' data to a folder of its own and reads it back ---


@query("src1_read_cells", ("cells",), "SELECT layer_id, count(*) AS n, round(sum(value), 2) AS total, CAST(1 AS BIGINT) AS has_source FROM cells GROUP BY layer_id")
def src1(v):
    out = folder(v.spark)
    v.cells.write.partitionBy("layer_id").parquet(out)
    read = io.read_cells(v.spark, f"{out}/layer_id=*", basePath=out)
    return read.groupBy("layer_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.max(F.col("source_file").contains("layer_id=").cast("long")).alias("has_source"))


@query("src2_decode_packed", (), "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 10 <> 0 THEN (l_partkey % 30000) * 0.25::DOUBLE - 100 END AS value FROM lineitem")
def src2(v):
    k = F.col("l_partkey")
    raw = v.table("lineitem").select("l_orderkey", "l_linenumber", F.when(k % 10 == 0, -999).otherwise(k % 30000).cast("short").alias("raw"), F.lit(0.25).alias("scale"), F.lit(-100.0).alias("offset"), F.lit(-999).cast("short").alias("missing"))
    return io.decode_packed(raw).select("l_orderkey", "l_linenumber", "value")


@query("src4_time_from_filename", (), """
SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS t, CASE WHEN o_orderkey % 9 = 0 THEN 'no date in SST.nc' END AS error FROM orders""")
def src4(v):
    name = F.when(F.col("o_orderkey") % 9 == 0, "/data/SST.nc").otherwise(F.concat(F.lit("/data/SST_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".nc")))
    out = io.time_from_filename(v.table("orders").select("o_orderkey", name.alias("source_file")), *io.DAILY_NAME)
    return out.select("o_orderkey", F.col("t").cast("timestamp_ntz").alias("t"), "error")


@query("src5_mask_nonpositive", (), "SELECT event_id, CASE WHEN value - 50 > 0 THEN value - 50 END AS value FROM events")
def src5(v):
    return io.mask_nonpositive(v.table("events").select("event_id", (F.col("value") - 50).alias("value")))


def _write_rasters(folder: str):
    """One raster of 721 x 721 little-endian 16-bit numbers for each month, as a file of the folder that all tasks see."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for month, cells in zip(frame["month"], frame["cells"], strict=True):
                raster = np.zeros(io.POLAR_SIZE * io.POLAR_SIZE, "<i2")
                for c in cells:
                    raster[c["row"] * io.POLAR_SIZE + c["col"]] = c["n"]
                with open(f"{folder}/NL1999{month:02d}.v01.NSIDC8", "wb") as f:
                    f.write(raster.tobytes())
            yield frame[["month"]]

    return write


@query("src3_read_polar_binary", ("points",), """
WITH r AS (SELECT CAST(point_id % 4 + 1 AS INT) AS month, radians(x) AS lam, 2 * 6371.228 / 25.067525 * sin(pi() / 4 - radians(y) / 2) AS rho FROM points WHERE y BETWEEN 0 AND 90),
c AS (SELECT month, CAST(floor(360 + rho * cos(lam) + 0.5) AS INT) AS j, CAST(floor(360 + rho * sin(lam) + 0.5) AS INT) AS i, count(*) AS n FROM r GROUP BY 1, 2, 3)
SELECT 'swe' AS layer_id, make_timestamp(1999, month, 1, 0, 0, 0) AS t, CAST(0 AS INT) AS z_index, j, i, CAST(least(n, 30000) AS DOUBLE) AS value FROM c""")
def src3(v):
    """Rasters of how many points fall in each polar cell, a file a month, read by the reader of that name."""
    out = folder(v.spark).removeprefix("file://").removeprefix("file:")
    os.makedirs(out)
    placed = coords.polar_cell_index(v.points.withColumnsRenamed({"x": "lon", "y": "lat"})).filter("row is not null").withColumn("month", (F.col("point_id") % 4 + 1).cast("int"))
    counts = placed.groupBy("month", "row", "col").agg(F.least(F.count("*"), F.lit(30000)).cast("int").alias("n"))
    rasters = counts.groupBy("month").agg(F.collect_list(F.struct("row", "col", "n")).alias("cells"))  # 721 x 721 cells at most
    rasters.mapInPandas(_write_rasters(out), "month int").write.format("noop").mode("overwrite").save()
    cells = io.read_with("polar", v.spark, f"{out}/NL*.NSIDC8")
    return cells.withColumn("t", F.col("t").cast("timestamp_ntz"))


@query("snk1_write_usage_csv", ("usage_log",), "SELECT * FROM usage_log")
def snk1(v):
    out = folder(v.spark)
    io.write_usage_csv(v.usage_log, out)
    kinds = {f.name: f.dataType for f in v.usage_log.schema}
    read = v.spark.read.option("header", True).csv(out)
    return read.select(*[F.col(c).cast(kinds[c]).alias(c) for c in read.columns])


@query("snk2_write_feature_info", ("cells", "requests"), f"""
WITH rq AS (SELECT *, {WORLD_I} AS i, {WORLD_J} AS j FROM requests), ts AS (SELECT DISTINCT layer_id, t FROM cells)
SELECT rq.request_id, rq.x AS lon, rq.y AS lat, rq.i, rq.j, CAST(-175 + 10 * rq.i AS DOUBLE) AS cell_x, CAST(-85 + 10 * rq.j AS DOUBLE) AS cell_y, strftime(ts.t, '%Y-%m-%d') AS time, coalesce(CAST(c.value AS STRING), 'none') AS value
FROM rq JOIN ts ON ts.layer_id = rq.layer_id LEFT JOIN cells c ON c.layer_id = rq.layer_id AND c.t = ts.t AND c.z_index = rq.z_index AND c.j = rq.j AND c.i = rq.i""")
def snk2(v):
    out = folder(v.spark)
    asked = v.requests.withColumn("grid_id", F.lit(WORLD)).drop("t")
    series = extract.read_timeseries(v.cells, v.cells.select("layer_id", "t").distinct(), v.world_axes, asked).groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("t", "value"))).alias("series"))
    placed = extract.point_map(v.world_axes, asked).select("request_id", F.col("x").alias("lon"), F.col("y").alias("lat"), "i", "j", (F.col("i") * 10.0 - 175).alias("cell_x"), (F.col("j") * 10.0 - 85).alias("cell_y"))
    io.write_feature_info(placed.join(series, "request_id"), out)
    read = v.spark.read.schema("request_id long, lon double, lat double, i int, j int, cell_x double, cell_y double, series array<struct<time:string,value:string>>").json(out)
    return read.select("request_id", "lon", "lat", "i", "j", "cell_x", "cell_y", F.explode("series").alias("s")).select("request_id", "lon", "lat", "i", "j", "cell_x", "cell_y", "s.time", "s.value")


@query("snk3_write_transect", ("cells", "lines"), TRANSECT + """
SELECT mp.line_id, CAST(40 AS INT) AS count, mp.k, round(round(p.x, 9), 6) AS x, round(round(p.y, 9), 6) AS y, coalesce(CAST(c.value AS STRING), 'none') AS value FROM mp JOIN path p ON p.line_id = mp.line_id AND p.k = mp.k CROSS JOIN one
LEFT JOIN cells c ON c.layer_id = 'N' AND c.t = one.t AND c.z_index = 2 AND c.j = mp.j AND c.i = mp.i""")
def snk3(v):
    out = folder(v.spark)
    io.write_transect(extract.transect(v.cells, v.world_axes, transect_points(v).withColumn("z_index", F.lit(2))), out, ["line_id"], "xml")
    read = v.spark.read.format("xml").option("rowTag", "transect").schema("line_id long, count int, points array<struct<k:int,x:double,y:double,value:string>>").load(out)
    return read.select("line_id", "count", F.explode("points").alias("p")).select("line_id", "count", "p.k", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"), "p.value")


@query("snk4_write_tiles", ("cells",), """
WITH z AS (SELECT unnest([1, 2]) AS zoom),
cs AS (SELECT zoom, k, CAST(floor(((k + 0.5::DOUBLE) * (360.0::DOUBLE / (pow(2, zoom) * 16)) - 180 + 175) / 10 + 0.5) AS INT) AS i FROM (SELECT zoom, unnest(range(CAST(16 * pow(2, zoom) AS BIGINT))) AS k FROM z)),
rs AS (SELECT zoom, k, CAST(floor(((k + 0.5::DOUBLE) * (360.0::DOUBLE / (pow(2, zoom) * 16)) - 90 + 85) / 10 + 0.5) AS INT) AS j FROM (SELECT zoom, unnest(range(CAST(8 * pow(2, zoom) AS BIGINT))) AS k FROM z))
SELECT c.layer_id, c.t, c.z_index, CAST(cs.zoom AS INT) AS zoom, CAST(rs.k // 16 AS INT) AS tile_row, CAST(cs.k // 16 AS INT) AS tile_col, CAST(cs.k % 16 AS INT) AS px, CAST(rs.k % 16 AS INT) AS py, c.value
FROM cells c JOIN cs ON cs.i = c.i JOIN rs ON rs.j = c.j AND rs.zoom = cs.zoom WHERE c.z_index = 0""")
def snk4(v):
    out = folder(v.spark)
    io.write_tiles(extract.tile_pyramid(v.cells.filter("z_index = 0"), v.world_axes, WORLD, (1, 2), 16), out)
    return v.spark.read.parquet(out).select("layer_id", "t", "z_index", "zoom", "tile_row", "tile_col", "px", "py", "value")


@query("str1_stream_usage_log", ("map_requests",), _ENTRY_SQL)
def str1(v):
    source, log, checkpoint = folder(v.spark), folder(v.spark), folder(v.spark)
    v.map_requests.write.parquet(source)
    requests = usage.stream_requests(v.spark, source, "request_id long, url string")
    usage.stream_usage_log(_parsed(requests), log, checkpoint).awaitTermination()
    return v.spark.read.parquet(log)


@query("str2_stream_usage_by", ("usage_log",), """
SELECT client_hostname, count(*) AS requests, count(*) FILTER (used_cache) AS cached, count(*) FILTER (used_cache) * 100.0::DOUBLE / count(*) AS percent FROM usage_log WHERE wms_operation = 'GetMap' GROUP BY 1""")
def str2(v):
    source, out, checkpoint = folder(v.spark), folder(v.spark), folder(v.spark)
    v.usage_log.select("client_hostname", "wms_operation", "used_cache").write.parquet(source)
    stream = usage.stream_requests(v.spark, source, "client_hostname string, wms_operation string, used_cache boolean")
    usage.start_usage_by(stream, "client_hostname", out, checkpoint).awaitTermination()
    return usage.read_usage_by(v.spark, "client_hostname", out)
