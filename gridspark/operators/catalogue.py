"""The catalogue and request tables (CAT)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.calendars import calendar_name, format_iso
from gridspark.functions.columns import let
from gridspark.operators import coords, elevation, stats, timeaxis

#: The states in which a dataset's layers are shown.
READY = ("READY", "UPDATING")
MOST_BANDS = 254


def apply_overrides(layers: DataFrame, overrides: DataFrame) -> DataFrame:
    """layers (dataset_id, layer_id, title, vmin, vmax, ...) with what overrides say about title, range, palette and bands.

    A range that neither side has becomes the default range.
    """
    own = overrides.select("dataset_id", "layer_id", *[F.col(c).alias("_" + c) for c in ("title", "vmin", "vmax", "palette", "bands")])
    joined = layers.join(own, ["dataset_id", "layer_id"], "left")
    ranged = stats.default_colour_range(joined)
    given = F.col("_vmin").isNotNull() & F.col("_vmax").isNotNull()
    return ranged.withColumns({
        "title": F.coalesce("_title", "title"), "vmin": F.when(given, F.col("_vmin")).otherwise(F.col("vmin")), "vmax": F.when(given, F.col("_vmax")).otherwise(F.col("vmax")),
        "palette": F.coalesce("_palette", F.lit("rainbow")), "bands": F.coalesce("_bands", F.lit(MOST_BANDS))}).drop("_title", "_vmin", "_vmax", "_palette", "_bands")


def variable_title(df: DataFrame) -> Column:
    """The standard name, else the long name, else the id; blanks count as missing."""
    full = lambda c: F.when(F.trim(c) != "", F.col(c))
    return F.coalesce(full("standard_name"), full("long_name"), F.col("id"))


def layer_name(dataset: Column, layer: Column) -> Column:
    return F.concat_ws("/", dataset, layer)


def split_layer_name(c: Column) -> tuple[Column, Column]:
    """(dataset, layer), cut at the last slash, which must not be the first character; nulls otherwise."""
    form = r"^(.+)/([^/]*)$"
    ok = c.rlike(form)
    return F.when(ok, F.regexp_extract(c, form, 1)), F.when(ok, F.regexp_extract(c, form, 2))


def resolve_layers(requests: DataFrame, layers: DataFrame, name: str = "layer_name") -> DataFrame:
    """requests with the row of the layer that they name."""
    dataset, layer = split_layer_name(F.col(name))
    return requests.withColumns({"dataset_id": dataset, "layer_id": layer}).join(layers, ["dataset_id", "layer_id"])


def unknown_layers(requests: DataFrame, layers: DataFrame, name: str = "layer_name") -> DataFrame:
    dataset, layer = split_layer_name(F.col(name))
    return requests.withColumns({"dataset_id": dataset, "layer_id": layer}).join(layers, ["dataset_id", "layer_id"], "left_anti")


def ready_layers(layers: DataFrame, datasets: DataFrame) -> DataFrame:
    """Layers of datasets that are enabled and ready or updating."""
    return layers.join(datasets.filter(~F.col("disabled") & F.col("state").isin(*READY)), "dataset_id", "left_semi")


def capabilities_table(layers: DataFrame, datasets: DataFrame, z_axis: DataFrame, steps: DataFrame, now: str, verbose: bool = False) -> DataFrame:
    """(name, title, west, east, south, north, elevations, default_elevation, times, default_time): a row per ready layer.

    z_axis and steps are per layer_id; a layer without an axis has nulls.  times is the compressed list, or the whole.
    """
    kind = dict(steps.dtypes)["t"]
    ready = ready_layers(layers, datasets)
    z = z_axis.groupBy("layer_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("z_index", "z"))), lambda s: s["z"].cast("string")), ",").alias("elevations"))
    z = z.join(elevation.default_elevation(z_axis).withColumnRenamed("z", "default_elevation"), "layer_id")
    if verbose:
        times = steps.select("layer_id", "t").distinct().groupBy("layer_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("t")), format_iso), ",").alias("times"))
    else:
        times = timeaxis.time_ranges(steps)
    default = steps.groupBy("layer_id").agg(format_iso(F.coalesce(F.max(F.when(F.col("t") <= F.lit(now).cast(kind), F.col("t"))), F.min("t"))).alias("default_time"))
    out = ready.join(z, "layer_id", "left").join(times, "layer_id", "left").join(default, "layer_id", "left")
    return out.select(layer_name(F.col("dataset_id"), F.col("layer_id")).alias("name"), "title", "west", "east", "south", "north", "elevations", "default_elevation", "times", "default_time")


def style_rows(layers: DataFrame, palettes: DataFrame, vector: Column) -> DataFrame:
    """(dataset_id, layer_id, style): every style with every palette; ``vector`` first, for vector layers only."""
    styles = F.explode(F.when(vector, F.array(F.lit("vector"), F.lit("boxfill"))).otherwise(F.array(F.lit("boxfill")))).alias("style")
    names = palettes.select("palette").distinct().agg(F.sort_array(F.collect_list("palette")).alias("names"))
    both = layers.select("dataset_id", "layer_id", styles).join(F.broadcast(names))  # one row
    return both.select("dataset_id", "layer_id", "style", F.explode("names").alias("palette")).select("dataset_id", "layer_id", F.concat_ws("/", "style", "palette").alias("style"))


def layer_details(layers: DataFrame, z_axis: DataFrame, steps: DataFrame, palettes: DataFrame, target: str) -> DataFrame:
    """(layer_id, details): a nested record per layer as JSON.

    layers: (layer_id, units, west, south, east, north, vmin, vmax, bands, vector, calendar, palette, log).
    """
    z = z_axis.groupBy("layer_id").agg(F.struct(F.first("units").alias("units"), F.first("positive").alias("positive"), F.transform(F.sort_array(F.collect_list(F.struct("z_index", "z"))), lambda s: s["z"]).alias("values")).alias("zaxis"))
    kind = dict(steps.dtypes)["t"]
    off = F.abs(F.unix_micros(F.col("t").cast("timestamp")) - F.unix_micros(F.lit(target).cast(kind).cast("timestamp")))
    near = steps.groupBy("layer_id").agg(format_iso(F.min_by("t", F.struct(off, "t"))).alias("nearest"))
    names = palettes.select("palette").distinct().agg(F.sort_array(F.collect_list("palette")).alias("palettes"))
    rows = layers.join(z, "layer_id", "left").join(timeaxis.dates_with_data(steps), "layer_id", "left").join(near, "layer_id", "left").join(F.broadcast(names))  # one row
    record = F.struct(
        "units", F.array("west", "south", "east", "north").alias("bbox"), F.array("vmin", "vmax").alias("scaleRange"), F.col("bands").alias("numColorBands"),
        F.when(F.col("vector"), F.array(F.lit("vector"), F.lit("boxfill"))).otherwise(F.array(F.lit("boxfill"))).alias("supportedStyles"), "zaxis",
        F.transform_keys("dates", lambda y, m: y.cast("string")).alias("datesWithData"), F.col("nearest").alias("nearestTimeIso"), calendar_name(F.col("calendar")).alias("timeAxisUnits"),
        "palettes", F.col("palette").alias("defaultPalette"), F.col("log").alias("logScaling"))
    return rows.select("layer_id", F.to_json(record).alias("details"))


def parse_request_params(requests: DataFrame, url: str = "url") -> DataFrame:
    """requests with params: names lower-cased, both sides decoded and trimmed, the first value of a name."""
    query = F.coalesce(F.regexp_extract(F.col(url), r"\?([^#]*)", 1), F.lit(""))
    pairs = F.filter(F.split(query, "&"), lambda p: p.contains("="))
    clean = lambda c: F.trim(F.try_url_decode(c))
    entries = F.transform(pairs, lambda p: F.struct(F.lower(clean(F.substring_index(p, "=", 1))).alias("k"), clean(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("v")))
    named = F.filter(entries, lambda e: e["k"].isNotNull())
    # the decoded list is worked out once, not for every name
    first = lambda found, k: F.struct(k.alias("k"), F.element_at(F.filter(found, lambda e: e["k"] == k), 1)["v"].alias("v"))
    params = let(named, lambda found: F.map_from_entries(F.transform(F.array_distinct(F.transform(found, lambda e: e["k"])), lambda k: first(found, k))))
    return requests.withColumn("params", params)


def parse_map_requests(requests: DataFrame) -> DataFrame:
    """requests (params) with layer, crs, box, size, time, elevation, style, range, bands, opacity, colour, flags, error.

    The error is the first of a request; its columns are null then, apart from the error.
    """
    p = lambda k: F.try_element_at(F.col("params"), F.lit(k))
    number = lambda k, default: F.when(p(k).isNull(), F.lit(default)).otherwise(p(k).try_cast("int"))
    new = F.coalesce(p("version"), F.lit("")) == "1.3.0"
    crs = F.when(new, p("crs")).otherwise(p("srs"))
    lat_first = new & (F.upper(crs) == "EPSG:4326")
    csr = F.lower(F.coalesce(p("colorscalerange"), F.lit("default")))
    ends = F.split(csr, ",")
    low, high = F.try_element_at(ends, F.lit(1)).try_cast("double"), F.try_element_at(ends, F.lit(2)).try_cast("double")
    explicit = ~csr.isin("default", "auto")
    bg = F.coalesce(p("bgcolor"), F.lit("0xFFFFFF"))
    boxed = coords.parse_bbox(requests.withColumn("_bbox", p("bbox")), "_bbox", ~F.coalesce(lat_first, F.lit(False))).withColumnRenamed("error", "_box_error")
    flag = lambda k: F.lower(p(k))
    bad = lambda c: F.coalesce(c < 0, F.lit(True))
    error = (F.when(p("layers").isNull(), "layers wanted").when(F.size(F.split(p("layers"), ",")) > 1, "one layer only").when(crs.isNull(), "reference system wanted")
             .when(F.col("_box_error").isNotNull(), F.concat(F.lit("bbox: "), F.col("_box_error")))
             .when(bad(p("width").try_cast("int")) | bad(p("height").try_cast("int")), "width and height wanted").when(p("styles").isNull(), "styles wanted").when(p("format").isNull(), "format wanted")
             .when(~bg.rlike("^0x[0-9A-Fa-f]{6}$"), "bad bgcolor").when(bad(number("opacity", 100)), "bad opacity")
             .when(explicit & ((F.size(ends) != 2) | low.isNull() | high.isNull() | (low > high)), "bad colorscalerange")
             .when(bad(number("numcolorbands", MOST_BANDS)), "bad numcolorbands").when(p("logscale").isNotNull() & ~flag("logscale").isin("true", "false"), "bad logscale")
             .when(p("transparent").isNotNull() & ~flag("transparent").isin("true", "false"), "bad transparent"))
    out = boxed.withColumn("error", error)
    cols = {
        "layer": p("layers"), "crs": F.when(F.upper(crs) == "EPSG:4326", "CRS:84").otherwise(crs), "min_x": F.col("min_x"), "min_y": F.col("min_y"), "max_x": F.col("max_x"), "max_y": F.col("max_y"),
        "width": p("width").try_cast("int"), "height": p("height").try_cast("int"), "time": p("time"), "elevation": p("elevation"), "style": F.element_at(F.split(p("styles"), ","), 1), "format": F.regexp_replace(p("format"), " ", "+"),
        "range_kind": F.when(explicit, "given").otherwise(csr), "vmin": F.when(explicit, low), "vmax": F.when(explicit, high), "bands": F.least(number("numcolorbands", MOST_BANDS), F.lit(MOST_BANDS)),
        "opacity": F.least(number("opacity", 100), F.lit(100)), "background": F.conv(F.substring(bg, 3, 6), 16, 10).try_cast("int"), "transparent": F.coalesce(flag("transparent") == "true", F.lit(False)), "log_scale": flag("logscale") == "true"}
    return out.withColumns({k: F.when(F.col("error").isNull(), c) for k, c in cols.items()}).drop("_bbox", "_box_error")


def parse_colour_range(df: DataFrame, text: str = "text") -> DataFrame:
    """df with vmin and vmax of "a b" (a comma may be the decimal mark), "a,b" or "a,b,c,d" (a.b and c.d); max is not below min."""
    words, parts = F.split(F.trim(text), " "), F.split(F.trim(text), ",")
    w = lambda k: F.replace(F.try_element_at(words, F.lit(k)), F.lit(","), F.lit("."))
    c = lambda k: F.try_element_at(parts, F.lit(k))
    two, one = F.size(words) == 2, F.size(words) == 1
    low = F.when(two, w(1)).when(one & (F.size(parts) == 2), c(1)).when(one & (F.size(parts) == 4), F.concat_ws(".", c(1), c(2)))
    high = F.when(two, w(2)).when(one & (F.size(parts) == 2), c(2)).when(one & (F.size(parts) == 4), F.concat_ws(".", c(3), c(4)))
    low, high = low.try_cast("double"), high.try_cast("double")
    ok = low.isNotNull() & high.isNotNull()
    return df.withColumns({"vmin": F.when(ok, low), "vmax": F.when(ok, F.greatest(low, high))})


#: The columns of the usage log and their types, in order.
USAGE = """request_time timestamp, client_ip string, client_hostname string, client_referrer string, client_user_agent string, http_method string, wms_version string,
wms_operation string, exception_class string, exception_message string, crs string, bbox_minx double, bbox_miny double, bbox_maxx double, bbox_maxy double, elevation string,
time_str string, num_timesteps int, image_width int, image_height int, layer string, dataset_id string, variable_id string, time_to_extract_data_ms int, used_cache boolean,
feature_info_lon double, feature_info_lat double, feature_info_col int, feature_info_row int, style_str string, output_format string, transparent boolean, background_color string,
menu string, remote_server_url string"""


def usage_entries(requests: DataFrame) -> DataFrame:
    """Parsed requests as rows of the usage log, 35 columns; what a request table hasn't got is null.

    Column names follow parse_map_requests and the log itself.
    """
    names = {"bbox_minx": "min_x", "bbox_miny": "min_y", "bbox_maxx": "max_x", "bbox_maxy": "max_y", "time_str": "time", "image_width": "width", "image_height": "height", "style_str": "style", "output_format": "format", "wms_version": "version", "exception_message": "error"}
    dataset, variable = split_layer_name(F.col("layer")) if "layer" in requests.columns else (F.lit(None), F.lit(None))
    made = {"dataset_id": dataset, "variable_id": variable}
    if "background" in requests.columns:
        b = F.col("background")
        made["background_color"] = F.when(b.isNotNull(), F.concat_ws(",", F.shiftright(b, 16).cast("string"), (F.shiftright(b, 8) % 256).cast("string"), (b % 256).cast("string")))
    out = []
    for column in USAGE.replace("\n", " ").split(","):
        name, kind = column.split()
        source = made.get(name, F.col(name) if name in requests.columns else F.col(names[name]) if names.get(name) in requests.columns else F.lit(None))
        out.append(source.cast(kind).alias(name))
    return requests.select(*out)
