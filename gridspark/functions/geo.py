"""Columns for longitudes, axes and map projections."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the projections: radii in metres, the polar grid in kilometres.
WEB_RADIUS = 6378137.0
EASE_RADIUS = 6371228.0
POLAR_RADIUS_KM, POLAR_CELL_KM, POLAR_SIZE = 6371.228, 25.067525, 721

LON_LAT = ("CRS:84", "EPSG:4326")


def constrain_longitude_360(c: Column) -> Column:
    """Into [0, 360)."""
    turned = c % 360
    return F.when(turned < 0, turned + 360).otherwise(turned)


def constrain_longitude_180(c: Column) -> Column:
    """Into (-180, 180]: -180 becomes 180."""
    turned = constrain_longitude_360(c)
    return F.when(turned > 180, turned - 360).otherwise(turned)


def next_equivalent_longitude(ref: Column, c: Column) -> Column:
    """The smallest longitude that equals c and isn't below ref."""
    return ref + constrain_longitude_360(c - ref)


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def regular_extent(first: Column, spacing: Column, size: Column) -> tuple[Column, Column]:
    """(min, max) of an axis with half a cell at both ends; one value has no width."""
    last = first + (size - 1) * spacing
    half = F.abs(spacing) / 2
    low, high = F.least(first, last), F.greatest(first, last)
    return F.when(size == 1, first).otherwise(low - half), F.when(size == 1, first).otherwise(high + half)


def regular_index(x: Column, first: Column, spacing: Column, size: Column, is_longitude: Column) -> Column:
    """Index of the cell of a regular axis that holds x; null outside.  Longitudes wrap from the extent's start."""
    low, high = regular_extent(first, spacing, size)
    at = F.when(is_longitude, next_equivalent_longitude(low, x)).otherwise(x)
    found = F.greatest(F.lit(0), F.least(size - 1, round_half_up((at - first) / spacing)))
    return F.when((at >= low) & (at <= high), found).cast("int")


def regular_exact(x: Column, first: Column, spacing: Column, size: Column, is_longitude: Column) -> Column:
    """Index of the value of a regular axis that equals x; null if there is none."""
    at = F.when(is_longitude, next_equivalent_longitude(regular_extent(first, spacing, size)[0], x)).otherwise(x)
    k = (at - first) / spacing
    hit = lambda i: F.when((i >= 0) & (i < size) & (first + i * spacing == at), i)
    return F.coalesce(hit(F.ceil(k)), hit(F.floor(k))).cast("int")


def count_below(sorted_values: Column, x: Column) -> Column:
    """How many values of an ascending array are below x, by bisection."""
    n = F.size(sorted_values)
    steps = F.sequence(F.lit(0), F.ceil(F.log2(n + 1.0)).cast("int"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.element_at(sorted_values, F.least(mid + 1, n)) < x
        moved = F.struct(F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(mid).alias("hi"))
        return F.when(s["lo"] < s["hi"], moved).otherwise(s)

    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve)["lo"]
    return F.when(n > 0, found).otherwise(0)


def project(lon: Column, lat: Column, crs: str) -> tuple[Column, Column]:
    """(x, y) in a coordinate reference system of a longitude and latitude."""
    if crs in LON_LAT:
        return lon, lat
    lam, phi = F.radians(lon), F.radians(lat)
    if crs == "EPSG:3857":
        return lam * WEB_RADIUS, F.log(F.tan(math.pi / 4 + phi / 2)) * WEB_RADIUS
    if crs == "EPSG:3408":  # azimuthal equal area, north
        rho = F.sin(math.pi / 4 - phi / 2) * (2 * EASE_RADIUS)
        return rho * F.sin(lam), -rho * F.cos(lam)
    if crs == "EPSG:3409":  # south
        rho = F.cos(math.pi / 4 - phi / 2) * (2 * EASE_RADIUS)
        return rho * F.sin(lam), rho * F.cos(lam)
    raise ValueError(f"unknown coordinate reference system: {crs}")


def unproject(x: Column, y: Column, crs: str) -> tuple[Column, Column]:
    """(longitude, latitude) of a position in a coordinate reference system."""
    if crs in LON_LAT:
        return x, y
    if crs == "EPSG:3857":
        return F.degrees(x / WEB_RADIUS), F.degrees(F.atan(F.exp(y / WEB_RADIUS)) * 2 - math.pi / 2)
    if crs in ("EPSG:3408", "EPSG:3409"):
        sign = 1 if crs == "EPSG:3408" else -1
        share = F.least(F.lit(1.0), F.sqrt(x * x + y * y) / (2 * EASE_RADIUS))
        return F.degrees(F.atan2(x, -y * sign)), F.degrees((math.pi / 2 - F.asin(share) * 2) * sign)
    raise ValueError(f"unknown coordinate reference system: {crs}")


def polar_cell(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(row, column) on the polar grid; null outside latitudes 0 to 90."""
    lam, phi = F.radians(lon), F.radians(lat)
    rho = F.sin(math.pi / 4 - phi / 2) * (2 * POLAR_RADIUS_KM / POLAR_CELL_KM)
    middle = (POLAR_SIZE - 1) / 2
    inside = (lat >= 0) & (lat <= 90)
    return tuple(F.when(inside, round_half_up(middle + rho * f(lam))).cast("int") for f in (F.cos, F.sin))


def dedupe_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")
