"""The gridded tables of the queries, as views over the test tables; the text is the same in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {}

VIEWS["cells"] = """
SELECT l_returnflag AS layer_id, CAST(date_trunc('year', l_shipdate) AS DATE) AS t, CAST(l_linenumber - 1 AS INT) AS z_index,
       CAST((l_orderkey * 5 + l_suppkey) % 18 AS INT) AS j, CAST((l_partkey * 7) % 36 AS INT) AS i, MAX(l_extendedprice) AS value
FROM lineitem GROUP BY 1, 2, 3, 4, 5"""

VIEWS["z_axis"] = """
SELECT layer_id, z_index, CAST(z AS DOUBLE) AS z, units, positive, pressure
FROM (SELECT DISTINCT l_returnflag AS layer_id, CAST(l_linenumber - 1 AS INT) AS z_index,
       CASE l_returnflag WHEN 'A' THEN CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN -5 WHEN 3 THEN -10 WHEN 4 THEN -20 WHEN 5 THEN -50 WHEN 6 THEN -100 ELSE -200 END
                         WHEN 'N' THEN CASE l_linenumber WHEN 1 THEN 1000 WHEN 2 THEN 925 WHEN 3 THEN 850 WHEN 4 THEN 700 WHEN 5 THEN 500 WHEN 6 THEN 300 ELSE 100 END
                         ELSE CASE l_linenumber WHEN 1 THEN 10 WHEN 2 THEN 2 WHEN 3 THEN 20 WHEN 4 THEN 50 WHEN 5 THEN 100 WHEN 6 THEN 200 ELSE 500 END END AS z,
       CASE l_returnflag WHEN 'N' THEN 'hPa' ELSE 'm' END AS units, l_returnflag = 'R' AS positive, l_returnflag = 'N' AS pressure
      FROM lineitem) AS v"""

VIEWS["points"] = """
SELECT event_id AS point_id, CAST((event_id * 7919) % 2880 AS DOUBLE) / 8 - 180 AS x, CAST((user_id * 104729 + event_id) % 1440 AS DOUBLE) / 8 - 90 AS y, ts
FROM events"""

VIEWS["file_times"] = """
SELECT o_orderstatus AS layer_id, CAST(o_orderdate AS DATE) AS t, concat('f', CAST(o_custkey % 50 AS STRING)) AS filename,
       CAST(o_orderkey % 24 AS INT) AS index_in_file, o_orderkey AS seen_order
FROM orders"""

VIEWS["steps"] = "SELECT DISTINCT o_orderstatus AS layer_id, CAST(o_orderdate AS DATE) AS t FROM orders"

VIEWS["event_steps"] = "SELECT DISTINCT concat('L', CAST(user_id % 5 AS STRING)) AS layer_id, ts AS t FROM events WHERE event_type = 'signup'"

VIEWS["event_targets"] = "SELECT event_id AS request_id, concat('L', CAST(user_id % 5 AS STRING)) AS layer_id, ts FROM events WHERE event_type = 'view'"

VIEWS["cf_times"] = """
SELECT event_id, CAST(event_id % 4000 AS DOUBLE) / 8 - 100 AS num,
       CASE event_type WHEN 'view' THEN 'days since 1970-1-1' WHEN 'click' THEN 'hours since 2000-2-28 12:0:0'
                       WHEN 'purchase' THEN 'min since 1999-12-30 0:0:0.5' WHEN 'signup' THEN 's since 1990-6-1 0:0:0 -6:00'
                       ELSE 'fortnights since 1990-1-1' END AS units,
       CASE user_id % 5 WHEN 0 THEN '360_day' WHEN 1 THEN 'noleap' WHEN 2 THEN 'all_leap' WHEN 3 THEN 'gregorian' ELSE 'julian' END AS calendar
FROM events"""

VIEWS["usage_log"] = """
SELECT ts AS request_time, concat('host', CAST(user_id % 17 AS STRING)) AS client_hostname, concat('agent', CAST(event_id % 5 AS STRING)) AS client_user_agent,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('ref', CAST(user_id % 7 AS STRING)) END AS client_referrer,
       CASE event_type WHEN 'view' THEN 'GetMap' WHEN 'click' THEN 'GetFeatureInfo' WHEN 'purchase' THEN 'GetTransect'
                       WHEN 'signup' THEN 'GetVerticalProfile' ELSE 'GetMetadata:menu' END AS wms_operation,
       event_id % 3 = 0 AS used_cache
FROM events"""

VIEWS["layers"] = """
SELECT p_partkey AS layer_no, concat('ds', CAST(p_partkey % 20 AS STRING)) AS dataset_id, concat('v', CAST(p_partkey AS STRING)) AS layer_id,
       concat(CASE p_partkey % 3 WHEN 0 THEN 'eastward_' WHEN 1 THEN 'northward_' ELSE 'speed_of_' END, 'flow_', CAST(CAST(floor(p_partkey / 60) AS INT) AS STRING)) AS title,
       CAST(p_size AS DOUBLE) AS vmin, CAST(p_retailprice AS DOUBLE) AS vmax
FROM part"""

VIEWS["datasets"] = """
SELECT concat('ds', CAST(n_nationkey AS STRING)) AS dataset_id, n_name AS title, n_regionkey = 3 AS disabled,
       CASE n_nationkey % 5 WHEN 0 THEN 'NEEDS_REFRESH' WHEN 1 THEN 'LOADING' WHEN 2 THEN 'READY' WHEN 3 THEN 'UPDATING' ELSE 'ERROR' END AS state
FROM nation"""

VIEWS["curv_cells"] = """
SELECT concat('g', CAST(CAST(floor(p_partkey / 2000) AS INT) AS STRING)) AS grid_id, CAST(p_partkey % 20 AS INT) AS i, CAST(floor((p_partkey % 2000) / 20) AS INT) AS j,
       CASE WHEN p_partkey % 97 = 50 THEN NULL ELSE CAST(p_partkey % 20 AS DOUBLE) * 2 + floor((p_partkey % 2000) / 20) / 4 - 60 END AS lon,
       CASE WHEN p_partkey % 97 = 50 THEN NULL ELSE floor((p_partkey % 2000) / 20) * 3 / 4 + CAST(p_partkey % 20 AS DOUBLE) / 8 - 40 END AS lat
FROM part"""

VIEWS["curv_points"] = """
SELECT event_id AS point_id, concat('g', CAST(CAST(floor((event_id % 20000) / 2000) AS INT) AS STRING)) AS grid_id,
       CAST((event_id * 7919) % 640 AS DOUBLE) / 8 - 68 + CAST(1 AS DOUBLE) / 32 AS lon, CAST((user_id * 104729 + event_id) % 704 AS DOUBLE) / 8 - 44 + CAST(1 AS DOUBLE) / 64 AS lat
FROM events"""

VIEWS["lines"] = """
SELECT s_suppkey AS line_id,
       concat(CAST((s_suppkey * 37) % 360 - 180 AS STRING), ' ', CAST((s_suppkey * 11) % 160 - 80 AS STRING), ', ',
              CAST((s_suppkey * 53 + 90) % 360 - 180 AS STRING), '  ', CAST((s_suppkey * 29 + 40) % 160 - 80 AS STRING), ', ',
              CAST((s_suppkey * 71 + 30) % 360 - 180 AS STRING), ' ', CAST((s_suppkey * 17 + 20) % 160 - 80 AS STRING)) AS linestring
FROM supplier"""

VIEWS["map_requests"] = """
SELECT event_id AS request_id,
       concat('http://h/wms?REQUEST=GetMap&Layers=ds1%2F', CASE user_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END,
              '&version=', CASE event_id % 2 WHEN 0 THEN '1.3.0&CRS=EPSG:4326' ELSE '1.1.1&SRS=EPSG:4326' END,
              '&bbox=', CASE WHEN event_id % 11 = 0 THEN '10,10,0,20' ELSE '-40,-20,40,60' END,
              '&width=', CAST(event_id % 512 + 1 AS STRING), '&HEIGHT=256&styles=&format=image/png',
              '&colorscalerange=', CASE event_id % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'default' WHEN 2 THEN '-5,5' ELSE 'x,1' END,
              '&numcolorbands=', CAST(event_id % 400 AS STRING)) AS url
FROM events"""

# --- further views, in eighths and quarters so that doubles are exact ---

VIEWS["world_axes"] = """
SELECT DISTINCT 'world' AS grid_id, 'x' AS axis, CAST(-175 AS DOUBLE) AS first, CAST(10 AS DOUBLE) AS spacing, 36 AS size, true AS is_longitude FROM region
UNION ALL
SELECT DISTINCT 'world', 'y', CAST(-85 AS DOUBLE), CAST(10 AS DOUBLE), 18, false FROM region"""

VIEWS["part_axes"] = """
SELECT concat('g', CAST(p_partkey AS STRING)) AS grid_id, 'x' AS axis, CAST(p_partkey % 41 - 20 AS DOUBLE) / 4 AS first,
       CASE p_partkey % 4 WHEN 0 THEN 0.5 WHEN 1 THEN -0.25 WHEN 2 THEN 1.0 ELSE 2.5 END + CAST(0 AS DOUBLE) AS spacing, CAST(p_size AS INT) AS size, false AS is_longitude
FROM part"""

VIEWS["axis_values"] = """
SELECT axis_id, CAST(row_number() OVER (PARTITION BY axis_id ORDER BY CASE WHEN axis_id % 2 = 0 THEN coord ELSE -coord END) - 1 AS INT) AS idx, coord
FROM (SELECT DISTINCT CAST(o_custkey % 40 AS INT) AS axis_id, CAST((o_orderkey * o_orderkey) % 7001 AS DOUBLE) / 8 AS coord FROM orders) AS v"""

VIEWS["axis_points"] = """
SELECT event_id AS point_id, CAST(user_id % 40 AS INT) AS axis_id, CAST((event_id * 7919) % 16000 AS DOUBLE) / 16 - 40 AS x FROM events"""

VIEWS["bboxes"] = """
SELECT concat('b', CAST(n_nationkey AS STRING)) AS grid_id, CAST(n_nationkey * 7 - 90 AS DOUBLE) AS min_x, CAST(n_nationkey * 3 - 80 AS DOUBLE) AS min_y,
       CAST(n_nationkey * 7 - 90 + 16 + n_regionkey * 8 AS DOUBLE) AS max_x, CAST(n_nationkey * 3 - 80 + 32 AS DOUBLE) AS max_y, 8 AS width, 4 AS height
FROM nation"""

VIEWS["views_bbox"] = """
SELECT s_suppkey AS view_id, CAST((s_suppkey * 37) % 300 - 150 AS DOUBLE) AS min_x, CAST((s_suppkey * 11) % 120 - 60 AS DOUBLE) AS min_y,
       CAST((s_suppkey * 37) % 300 - 150 + s_suppkey % 40 + 1 AS DOUBLE) AS max_x, CAST((s_suppkey * 11) % 120 - 60 + s_suppkey % 25 + 1 AS DOUBLE) AS max_y
FROM supplier"""

VIEWS["nested_coords"] = """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN array(event_id % 7, user_id % 5) WHEN 1 THEN array(event_id % 7, user_id % 5, event_id % 4) ELSE array(user_id % 6) END AS c FROM events"""

VIEWS["requests"] = """
SELECT event_id AS request_id, CASE user_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS layer_id,
       CAST(CASE event_id % 7 WHEN 0 THEN '1992-01-01' WHEN 1 THEN '1993-01-01' WHEN 2 THEN '1994-01-01' WHEN 3 THEN '1995-01-01' WHEN 4 THEN '1996-01-01' WHEN 5 THEN '1997-01-01' ELSE '1998-01-01' END AS DATE) AS t,
       CAST(event_id % 7 AS INT) AS z_index, CAST((event_id * 7919) % 2880 AS DOUBLE) / 8 - 180 AS x, CAST((user_id * 104729 + event_id) % 1440 AS DOUBLE) / 8 - 90 AS y
FROM events"""


def _needs(name: str) -> list[str]:
    """The views that a view reads, itself last."""
    out: list[str] = []
    for other in VIEWS:
        if other != name and re.search(rf"\b(FROM|JOIN) {other}\b", VIEWS[name]):
            out += [x for x in _needs(other) if x not in out]
    return [*out, name]


def with_views(names: tuple[str, ...]) -> str:
    """The WITH clause of the views, for DuckDB."""
    order: list[str] = []
    for name in names:
        order += [x for x in _needs(name) if x not in order]
    fit = lambda s: re.sub(r"\barray\(([^()]*)\)", r"[\1]", s)
    return "WITH " + ",\n".join(f"{x} AS ({fit(VIEWS[x])})" for x in order) + "\n" if order else ""


class Views:
    """The views over one folder of tables, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        clauses = ", ".join(f"{x} AS ({VIEWS[x]})" for x in _needs(name))
        text = re.sub(rf"\bFROM ({'|'.join(TABLES)})\b", lambda m: f"FROM parquet.`{self.sf_dir}/{m[1]}.parquet`", f"WITH {clauses} SELECT * FROM {name}")
        return self.spark.sql(text)
