"""Value tables: longitudes, axes, calendars, periods, palettes, text forms."""

from __future__ import annotations

import calendar
import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.functions import calendars, geo
from gridspark.operators import catalogue, colour, coords, curvilinear, elevation, extract, stats, timeaxis, vectors
from gridspark.sources import io


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize(("lon", "c180", "c360"), [(-0.1, -0.1, 359.9), (180.0, 180.0, 180.0), (180.1, -179.9, 180.1), (-180.0, 180.0, 180.0), (-180.1, 179.9, 179.9), (360.0, 0.0, 0.0), (720.0, 0.0, 0.0), (-540.0, 180.0, 180.0), (678.9, -41.1, 318.9)])
def test_longitudes(spark, lon, c180, c360):
    row = spark.range(1).select(geo.constrain_longitude_180(F.lit(lon)).alias("a"), geo.constrain_longitude_360(F.lit(lon)).alias("b")).first()
    assert row.a == pytest.approx(c180) and row.b == pytest.approx(c360)


def test_next_equivalent_longitude(spark):
    rows = spark.createDataFrame([(10.0, 5.0, 365.0), (-180.0, 5.0, 5.0), (-180.0, 365.0, 5.0), (-180.0, -355.0, 5.0)], "ref double, lon double, want double")
    assert rows.filter(geo.next_equivalent_longitude(F.col("ref"), F.col("lon")) != F.col("want")).count() == 0


def test_regular_axis(spark):
    axes = spark.createDataFrame([("a", "x", 0.0, 1.0, 10, False), ("g", "x", 0.0, 1.0, 360, True), ("d", "x", 90.0, -1.0, 181, False), ("s", "x", 5.0, 1.0, 1, False)], "grid_id string, axis string, first double, spacing double, size int, is_longitude boolean")
    want = [("a", -0.51, None), ("a", -0.49, 0), ("a", 0.499, 0), ("a", 0.5, 1), ("a", 0.501, 1), ("a", 9.499, 9), ("a", 9.501, None), ("g", -0.51, 359), ("g", 359.501, 0), ("g", 540.0, 180), ("d", 90.4, 0), ("d", -90.2, 180), ("s", 5.0, 0), ("s", 5.1, None), ("a", None, None)]
    pts = spark.createDataFrame(want, "grid_id string, x double, want int")
    got = pts.join(axes, "grid_id").withColumn("got", geo.regular_index(F.col("x"), F.col("first"), F.col("spacing"), F.col("size"), F.col("is_longitude")))
    assert got.filter(~F.col("got").eqNullSafe(F.col("want"))).collect() == []


def test_irregular_axis(spark):
    up, down = [0, 1.5, 3.5, 6, 10, 15, 25, 50, 100], [80, 75, 70, 60, 50, 30, 10, 5]
    values = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(up)] + [(1, i, float(v)) for i, v in enumerate(down)], "axis_id int, idx int, coord double")
    want = [(0, -0.76, None), (0, 0.749, 0), (0, 0.75, 0), (0, 0.751, 1), (0, 74.9, 7), (0, 75.1, 8), (0, 124.99, 8), (0, 125.01, None), (1, 85.0, None), (1, 79.0, 0), (1, 77.5, 1), (1, 77.49, 1), (1, 7.51, 6), (1, 7.5, 7), (1, 2.51, 7), (1, 2.49, None)]
    got = coords.nearest_index_irregular(spark.createDataFrame(want, "axis_id int, x double, want int"), values)
    assert got.filter(~F.col("idx").eqNullSafe(F.col("want"))).collect() == []


def test_axis_checks(spark):
    bad = [5, 4, 3, 3.5, 2, 1]
    values = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(bad)] + [(1, i, float(v)) for i, v in enumerate(bad[::-1])] + [(2, i, float(i)) for i in range(4)] + [(3, 0, 1.0)], "axis_id int, idx int, coord double")
    assert {r.axis_id: r.ok for r in coords.check_axis_monotonic(values).collect()} == {0: False, 1: False, 2: True, 3: True}


def test_world_point_is_one_cell(spark):
    axes = spark.createDataFrame([("w", "x", -180 + 0.18, 0.36, 1000, True), ("w", "y", -90 + 0.09, 0.18, 1000, False)], "grid_id string, axis string, first double, spacing double, size int, is_longitude boolean")
    found = extract.point_map(axes, spark.createDataFrame([("w", 0.0, 0.0)], "grid_id string, x double, y double"))
    assert extract.distinct_cells_sampled(found, ("grid_id",)).first().cells == 1


@pytest.mark.parametrize(("ms", "text"), [(1, "PT0.001S"), (10, "PT0.01S"), (100, "PT0.1S"), (999, "PT0.999S"), (150_500, "PT2M30.5S"), (86_400_000, "P1D"), (172_800_001, "P2DT0.001S"), (262_980_000, "P3DT1H3M")])
def test_periods(spark, ms, text):
    assert one(spark, calendars.format_period(F.lit(ms).cast("long"))) == text


@pytest.mark.parametrize(("text", "calendar", "ms"), [
    ("1970-1-1", "gregorian", 0), ("1970-1-1 0:0:0.1", "gregorian", 100), ("1992-10-8 15:15:42.5 -6:00", None, 718_578_942_500), ("1970", "360_day", 0),
    ("2000-02-30", "360_day", (30 * 360 + 59) * 86_400_000), ("2000-02-30", "gregorian", None), ("2000-01-31", "360_day", None), ("2000-02-29", "noleap", None), ("1999-02-29", "all_leap", (29 * 366 + 59) * 86_400_000), ("last week", "gregorian", None), (None, "gregorian", None)])
def test_time_bases(spark, text, calendar, ms):
    assert one(spark, calendars.parse_time_base(F.lit(text).cast("string"), F.lit(calendar).cast("string"))) == ms


@pytest.mark.parametrize("calendar", ["360_day", "noleap", "all_leap", "gregorian", "julian"])
def test_calendar_round_trip(spark, calendar):
    years = [-2000, -1, 0, 1969, 1970, 1971, 2000, 2100]
    dates = spark.createDataFrame([(y, m, d, 13, 45, 56, 789) for y in years for m in (1, 2, 3, 12) for d in (1, 28, 30)], "y int, m int, d int, h int, mi int, s int, ms int")
    instant = calendars.calendar_ms(F.lit(calendar), *[F.col(c) for c in ("y", "m", "d", "h", "mi", "s", "ms")])
    back = dates.withColumn("t", instant).filter("t is not null").withColumn("f", calendars.calendar_fields(F.col("t"), F.lit(calendar)))
    wrong = back.filter("f.year <> y or f.month <> m or f.day <> d or f.hour <> h or f.minute <> mi or f.second <> s or f.ms <> ms")
    assert wrong.collect() == [] and back.count() >= 8 * 11


def test_gregorian_agrees_with_python(spark):
    days = [-719162, -25567, -1, 0, 59, 11016, 47540, 100000]
    rows = spark.createDataFrame([(d,) for d in days], "d long").select("d", calendars.calendar_date(F.col("d"), F.lit("standard")).alias("f")).collect()
    for r in rows:
        want = datetime.date(1970, 1, 1) + datetime.timedelta(days=r.d)
        assert (r.f.year, r.f.month, r.f.day) == (want.year, want.month, want.day)


@pytest.mark.parametrize("calendar", ["360_day", "noleap", "all_leap"])
@pytest.mark.parametrize(("n", "year", "month"), [(4, 2001, 2), (-1, 2000, 9), (-11, 1999, 11), (26, 2002, 12), (0, 2000, 10)])
def test_add_months(spark, calendar, n, year, month):
    at = lambda y, m: calendars.calendar_ms(F.lit(calendar), *map(F.lit, (y, m, 1, 0, 0, 0, 0)))
    row = spark.range(1).select(calendars.calendar_add_months(at(2000, 10), F.lit(n), F.lit(calendar)).alias("got"), at(year, month).alias("want")).first()
    assert row.got == row.want


def steps(spark, times):
    return spark.createDataFrame([("L", t) for t in times], "layer_id string, t timestamp")


def ranges(spark, times):
    return timeaxis.time_ranges(steps(spark, times)).first().times


def test_time_ranges(spark):
    day = lambda d, h=0: datetime.datetime(2000, 1, 1, h) + datetime.timedelta(days=d)
    text = lambda t: t.strftime("%Y-%m-%dT%H:%M:%S.000Z")
    assert ranges(spark, [day(0)]) == text(day(0))
    assert ranges(spark, [day(0), day(1)]) == f"{text(day(0))},{text(day(1))}"
    assert ranges(spark, [day(d) for d in range(10)]) == f"{text(day(0))}/{text(day(9))}/P1D"
    # ten days, then ten days two apart: the border goes to the first of the two equal runs
    two = [day(d) for d in range(10)] + [day(9 + 2 * d) for d in range(1, 10)]
    assert ranges(spark, two) == f"{text(day(0))}/{text(day(9))}/P1D,{text(day(11))}/{text(day(27))}/P2D"
    # one day missing
    gap = [day(d) for d in range(20) if d != 10]
    assert ranges(spark, gap) == f"{text(day(0))}/{text(day(9))}/P1D,{text(day(11))}/{text(day(19))}/P1D"
    assert timeaxis.time_ranges(steps(spark, [])).collect() == []


def test_animation_labels(spark):
    hourly = [datetime.datetime(2000, 1, 1) + datetime.timedelta(hours=6 * k) for k in range(4 * 40)]
    found = {r.label: r.frames for r in timeaxis.animation_timesteps(steps(spark, hourly)).collect()}
    assert found == {"Full": 160, "Daily": 40, "Weekly": 6, "Monthly": 2}


def test_palettes(spark):
    pal = spark.createDataFrame([("p", i, *c) for i, c in enumerate([(0, 0, 0), (100, 200, 50), (255, 255, 255)])], "palette string, seq int, r int, g int, b int")
    wide = [tuple(r)[1:] for r in colour.resample_palette(pal, 9).orderBy("idx").collect()]
    assert wide[0] == (0, 0, 0, 0) and wide[-1] == (8, 255, 255, 255) and len(wide) == 9 and wide[5] == (5, 100, 200, 50)
    assert [r.r for r in colour.resample_palette(pal, 2).orderBy("idx").collect()] == [0, 255]
    assert [r.r for r in colour.resample_palette(pal, 3).orderBy("idx").collect()] == [0, 100, 255]
    with pytest.raises(ValueError):
        colour.resample_palette(pal, 255)
    wanted = spark.createDataFrame([("P ",), ("",), (None,), ("other",)], "palette string")
    assert {r.used for r in colour.palette_or_default(wanted, pal, "rainbow").collect()} == {"p", "rainbow"}


def test_colour_index(spark):
    rows = spark.createDataFrame([(None, 0.0, 1.0, 10), (0.0, 0.0, 1.0, 0), (1.0, 0.0, 1.0, 9), (1.1, 0.0, 1.0, 11), (2.0, 2.0, 2.0, 0), (2.0, None, None, 11)], "v double, a double, b double, want int")
    assert rows.filter(colour.colour_index(F.col("v"), F.col("a"), F.col("b"), 10) != F.col("want")).collect() == []


def test_elevation_rules(spark):
    z = spark.createDataFrame([("A", 0, 0.0, "m", False, False), ("A", 1, -5.0, "m", False, False), ("A", 2, 5.0, "m", False, False), ("P", 0, 1000.0, "hPa", False, True)], "layer_id string, z_index int, z double, units string, positive boolean, pressure boolean")
    asked = spark.createDataFrame([(1, "A", None), (2, "A", "0"), (3, "A", "-5.00004"), (4, "A", "1,2"), (5, "A", "0.00001"), (6, "P", None), (7, "none", "3")], "request_id int, layer_id string, elevation string")
    got = {r.request_id: (r.z_index, r.error) for r in elevation.match_elevation(asked, z).collect()}
    assert got == {1: (0, None), 2: (0, None), 3: (1, None), 4: (None, "one elevation only"), 5: (None, "no such elevation"), 6: (0, None), 7: (None, None)}


def test_vector_pairs(spark):
    layers = spark.createDataFrame([(1, "d", "a", "eastward_wind"), (2, "d", "b", "northward_wind"), (3, "d", "c", "eastward_wind"), (4, "e", "d", "eastward_wind"), (5, "d", "f", "eastward drift")], "layer_no int, dataset_id string, layer_id string, title string")
    assert [tuple(r) for r in vectors.find_vector_layers(layers).collect()] == [("d", "wind", "c", "b")]


def test_default_range_and_view_without_cells(spark):
    rows = spark.createDataFrame([(None, None), (2.0, 2.0), (0.0, 10.0)], "vmin double, vmax double")
    assert sorted(tuple(r) for r in stats.default_colour_range(rows).collect()) == [(-50.0, 50.0), (-0.5, 10.5), (2.0, 3.0)]


def test_layer_names(spark):
    rows = spark.createDataFrame([("a/b", "a", "b"), ("a/b/c", "a/b", "c"), ("/b", None, None), ("b", None, None), ("a/", "a", "")], "n string, d string, l string")
    d, x = catalogue.split_layer_name(F.col("n"))
    assert rows.filter(~d.eqNullSafe(F.col("d")) | ~x.eqNullSafe(F.col("l"))).collect() == []


def test_request_parameters(spark):
    urls = spark.createDataFrame([("http://h/w?A=1&a=2&B=x%20y&=z&c",), ("no query",), (None,)], "url string")
    assert [r.params for r in catalogue.parse_request_params(urls).collect()] == [{"a": "1", "b": "x y", "": "z"}, {}, {}]
    errors = catalogue.parse_map_requests(catalogue.parse_request_params(urls)).select("error").distinct().collect()
    assert [r.error for r in errors] == ["layers wanted"]


def test_grid_coordinates_round_trip(spark):
    low, high = [2, 0, -1], [4, 3, 5]
    rows = spark.range(3 * 4 * 7).select("id", *[c.alias(n) for n, c in zip("abc", coords.grid_coordinates(F.col("id"), low, high), strict=True)])
    assert rows.filter(coords.linear_index([F.col("a"), F.col("b"), F.col("c")], low, high) != F.col("id")).count() == 0
    assert one(spark, coords.linear_index([F.lit(9), F.lit(0), F.lit(0)], low, high)) == -1


@pytest.mark.parametrize("crs", ["EPSG:3857", "EPSG:3408", "EPSG:3409"])
def test_projections_round_trip(spark, crs):
    pts = spark.createDataFrame([(float(x), float(y)) for x in (-170, -30, 0, 10, 179) for y in (-80, -10, 5, 80)], "x double, y double")
    back = coords.transform_crs(coords.transform_crs(pts.withColumnsRenamed({"x": "a", "y": "b"}).withColumns({"x": F.col("a"), "y": F.col("b")}), "CRS:84", crs), crs, "EPSG:4326")
    assert back.filter((F.abs(F.col("x") - F.col("a")) > 1e-6) | (F.abs(F.col("y") - F.col("b")) > 1e-6)).count() == 0


def test_linestrings(spark):
    lines = spark.createDataFrame([(1, "0 0, 3  4,3 4"), (2, "1 1"), (3, "a 1, 2 2"), (4, None)], "line_id int, linestring string")
    assert [(r.seq, r.distance, r.fraction) for r in coords.parse_linestring(lines).orderBy("seq").collect()] == [(0, 0.0, 0.0), (1, 5.0, 1.0), (2, 5.0, 1.0)]
    assert sorted(r.line_id for r in coords.bad_linestrings(lines).collect()) == [2, 3, 4]
    points = extract.points_on_path(coords.parse_linestring(lines), 6).orderBy("k").collect()
    assert [(r.k, round(r.x, 9), round(r.y, 9)) for r in points] == [(k, round(0.6 * k, 9), round(0.8 * k, 9)) for k in range(6)]


def test_animation_thins_axes_of_any_year(spark):
    def model(times, months, days):
        """Add months with a clipped day, then days, by the calendar module's own rule for month lengths."""
        kept = [times[0]]
        for t in times[1:]:
            k = kept[-1]
            y, m = k.year + (k.month - 1 + months) // 12, (k.month - 1 + months) % 12 + 1
            due = datetime.datetime(y, m, min(k.day, calendar.monthrange(y, m)[1]), k.hour) + datetime.timedelta(days=days)
            if t >= due:
                kept.append(t)
        return kept

    for first in (1500, 1999, 3000):
        start = datetime.datetime(first, 1, 31, 6)
        times = [start + datetime.timedelta(days=d) for d in range(0, 1500, 3)]
        steps = spark.createDataFrame([("a", t.isoformat()) for t in times], "layer_id string, s string").select("layer_id", F.col("s").cast("timestamp").alias("t"))
        got = {r.label: r.times.split(",") for r in timeaxis.animation_timesteps(steps).filter("label <> 'Full'").collect()}
        for label, (months, days) in timeaxis.PERIODS.items():
            assert got[label] == [f"{t.isoformat()}.000Z" for t in model(times, months, days)]


def test_polar_files_and_readers(spark, tmp_path):
    raster = np.zeros((721, 721), "<i2")
    raster[3, 5], raster[700, 1], raster[9, 9] = 7, 300, -4
    for name in ("NL199903.v01.NSIDC8", "NL200112.v01.NSIDC8", "notes.NSIDC8"):
        (tmp_path / name).write_bytes(raster.tobytes())
    cells = sorted((r.t.isoformat(), r.j, r.i, r.value) for r in io.read_with("polar", spark, f"{tmp_path}/*.NSIDC8").collect())
    assert cells == [(f"{m}T00:00:00", j, i, v) for m in ("1999-03-01", "2001-12-01") for j, i, v in ((3, 5, 7.0), (700, 1, 300.0))]
    for size in (721 * 721 - 1, 721 * 721 + 1):
        (tmp_path / "NL199904.v01.NSIDC8").write_bytes(np.ones(size, "<i2").tobytes())
        with pytest.raises(Exception, match="where a raster of 721 x 721"):
            io.read_with("polar", spark, f"{tmp_path}/NL199904*").count()
    io.register_reader("twice", lambda s, glob: io.read_polar_binary(s, glob, "two"))
    assert {r.layer_id for r in io.read_with("twice", spark, f"{tmp_path}/NL199903*").collect()} == {"two"}
    with pytest.raises(ValueError, match="no reader"):
        io.read_with("unheard", spark, "/x")
    with pytest.raises(ValueError, match="absolute"):
        io.read_cells(spark, "relative/*.parquet")


def test_vector_layers_are_read_as_magnitudes(spark):
    cells = spark.createDataFrame([("u", 1, 0, 0, 0, 3.0), ("v", 1, 0, 0, 0, 4.0), ("u", 1, 0, 0, 1, 5.0), ("x", 1, 0, 0, 0, 9.0)], "layer_id string, t int, z_index int, j int, i int, value double")
    pairs = spark.createDataFrame([("uv", "u", "v"), ("ux", "u", "x")], "layer_id string, east_id string, north_id string")
    got = {(r.layer_id, r.i): r.value for r in vectors.with_vectors(cells, pairs).collect()}
    assert got == {("u", 0): 3.0, ("v", 0): 4.0, ("u", 1): 5.0, ("x", 0): 9.0, ("uv", 0): 5.0, ("uv", 1): None, ("ux", 0): 90**0.5, ("ux", 1): None}


def test_containing_cells_of_fine_and_coarse_grids(spark):
    rows = [(g, i, j, -179.0 + step * i, -60.0 + step * j) for g, step in (("fine", 0.05), ("coarse", 11.0)) for i in range(12) for j in range(8)]
    grid = spark.createDataFrame(rows, "grid_id string, i int, j int, lon double, lat double")
    at = spark.createDataFrame([(k, g, -179.0 + step * x, -60.0 + step * y) for k, (g, step, x, y) in enumerate((g, s, x, y) for g, s in (("fine", 0.05), ("coarse", 11.0)) for x in (0.2, 3.4, 10.9) for y in (0.3, 6.6))], "point_id long, grid_id string, lon double, lat double")
    got = {r.point_id: (r.i, r.j) for r in curvilinear.curv_containing(at, curvilinear.curv_tile_index(curvilinear.curv_cell_polygons(grid))).collect()}
    assert [got[k] for k in range(12)] == [(x, y) for _ in range(2) for x in (0, 3, 11) for y in (0, 7)]
