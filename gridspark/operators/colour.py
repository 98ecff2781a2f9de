"""Colour classification (COL)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.operators import extract, stats, vectors

MOST_COLOURS = 254


def colour_index(value: Column, vmin: Column, vmax: Column, n: Column | int, log: bool = False) -> Column:
    """Colour of a value: n for null, n + 1 outside the range or without one, else a band from 0 to n - 1.

    In a range without width, or on a logarithmic scale at or below 0, the band is 0.
    """
    n = F.lit(n) if isinstance(n, int) else n
    scale = (lambda c: F.when(c > 0, F.log(c))) if log else (lambda c: c)
    share = F.try_divide(scale(value) - scale(vmin), scale(vmax) - scale(vmin))
    band = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * n).cast("int"), n - 1)
    inside = F.coalesce((value >= vmin) & (value <= vmax), F.lit(False))
    return F.when(value.isNull(), n).when(~inside, n + 1).otherwise(band)


def read_palettes(files: DataFrame) -> DataFrame:
    """(palette, seq, r, g, b, error) of palette texts (path, value).

    A line has three numbers, 0 to 1 or 0 to 255; comments (#) and blank lines are skipped; others are errors.  The name
    is the file's, lower-cased and without its ending.
    """
    lines = files.select(F.lower(F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)).alias("palette"), F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    lines = lines.filter(~F.col("text").startswith("#") & (F.trim("text") != "")).withColumn("words", F.split(F.trim("text"), r"\s+"))
    c = [F.try_element_at("words", F.lit(k)).try_cast("double") for k in (1, 2, 3)]
    most, least = F.greatest(*c), F.least(*c)
    bad = c[0].isNull() | c[1].isNull() | c[2].isNull() | (least < 0) | (most > 255)
    lines = lines.withColumn("error", F.when(bad, "three numbers wanted"))
    level = lambda x: F.when(~bad, F.when(most > 1, x.cast("int")).otherwise(F.floor(x * 255 + 0.5).cast("int")))
    seq = F.row_number().over(Window.partitionBy("palette").orderBy("line")) - 1
    return lines.select("palette", seq.alias("seq"), *[level(x).alias(k) for x, k in zip(c, ("r", "g", "b"), strict=True)], "error")


def _resample(colours: list[tuple[int, int, int]], n: int) -> list[tuple[int, int, int]]:
    """n colours of a palette: its ends stay; fewer are picked, more are placed and the gaps filled in between."""
    size, half_up = len(colours), lambda v: int(v + 0.5)
    if n == size:
        return colours
    if n < size:
        picked = [colours[min(size - 1, half_up(size * i / (n - 1)))] for i in range(1, n - 1)]
        return ([colours[0], *picked] if n > 1 else []) + [colours[-1]]
    # every colour's place among n, then straight lines; the last stretch is measured to n, one past the end
    fixed = [(0, 0), *[(half_up(n * i / (size - 1)), i) for i in range(1, size - 1)], (n - 1, size - 1)] if size > 1 else [(0, 0), (n - 1, 0)]
    out: list = [None] * n
    for (a, x), (b, y) in zip(fixed, fixed[1:], strict=False):
        for j in range(a + 1, b):
            share = (j - a) / ((n if b == n - 1 and y == size - 1 else b) - a)
            out[j] = tuple(half_up(share * q + (1 - share) * p) for p, q in zip(colours[x], colours[y], strict=True))
        out[b] = colours[y]
    out[0] = colours[0]
    return out


def resample_palette(palettes: DataFrame, n: int) -> DataFrame:
    """(palette, idx, r, g, b): palettes (palette, seq, r, g, b) with n colours each, 254 at most."""
    if not 1 <= n <= MOST_COLOURS:
        raise ValueError(f"a palette has 1 to {MOST_COLOURS} colours")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, i, *c) for p, cs in zip(frame["palette"], frame["colours"], strict=True) for i, c in enumerate(_resample([(int(x["r"]), int(x["g"]), int(x["b"])) for x in cs], n))]
            yield pd.DataFrame(rows, columns=["palette", "idx", "r", "g", "b"])

    lists = palettes.groupBy("palette").agg(F.sort_array(F.collect_list(F.struct("seq", "r", "g", "b"))).alias("colours"))
    return lists.mapInPandas(run, "palette string, idx int, r int, g int, b int")


def palette_or_default(wanted: DataFrame, palettes: DataFrame, default: str) -> DataFrame:
    """wanted (palette) with used: the palette's own name, or the default's if it is empty or unknown."""
    known = palettes.select(F.col("palette").alias("used")).distinct()
    found = wanted.join(known, F.lower(F.trim("palette")) == F.col("used"), "left")
    return found.withColumn("used", F.coalesce("used", F.lit(default)))


def colour_table(palette: DataFrame, n: int, opacity: int = 100, background: tuple[int, int, int] = (255, 255, 255), transparent: bool = False) -> DataFrame:
    """(palette, idx, r, g, b, a): n colours, then the background, then black for values out of range."""
    alpha = 255 if opacity >= 100 else 0 if opacity <= 0 else int(2.55 * opacity)
    names = palette.select("palette").distinct()
    rgb = lambda idx, c, a: names.select("palette", F.lit(idx).alias("idx"), *[F.lit(x).alias(k) for x, k in zip(c, "rgb", strict=True)], F.lit(a).alias("a"))
    colours = palette.select("palette", "idx", "r", "g", "b", F.lit(alpha).alias("a"))
    return colours.unionByName(rgb(n, background, 0 if transparent else alpha)).unionByName(rgb(n + 1, (0, 0, 0), alpha))


def apply_palette(indexed: DataFrame, table: DataFrame) -> DataFrame:
    """indexed (idx, ...) with r, g, b, a of a colour table, which has 256 rows at most."""
    return indexed.join(F.broadcast(table.select("idx", "r", "g", "b", "a")), "idx")


def scale_ticks(ranges: DataFrame, log: bool = False) -> DataFrame:
    """ranges (vmin, vmax, ...) with tick0 to tick4 at quarters and third1, third2, on a linear or logarithmic scale."""
    low, high = (F.log("vmin"), F.log("vmax")) if log else (F.col("vmin"), F.col("vmax"))
    at = lambda share: F.exp(low + (high - low) * share) if log else low + (high - low) * share
    return ranges.withColumns({f"tick{k}": at(k / 4) for k in range(5)} | {"third1": at(1 / 3), "third2": at(2 / 3)})


def render_frames(frames: DataFrame, height: int, n: int = MOST_COLOURS, value_range: tuple[float, float] | DataFrame | None = None, log: bool = False, animation: list[str] | None = None) -> DataFrame:
    """frames (row, value, ...) with py (from the top), vmin, vmax and idx.

    The range is the given one, the layers' default ranges (layer_id, vmin, vmax; a layer without one, or one that isn't
    listed, has the default of an empty range), or the common one of the frames of an animation.  Frames with components east and north
    are classified by their magnitude.
    """
    if "east" in frames.columns:
        frames = vectors.magnitude(frames)
    if isinstance(value_range, DataFrame):
        joined = frames.join(value_range.select("layer_id", "vmin", "vmax"), "layer_id", "left")
        ranged = joined.withColumns({"vmin": F.when(F.col("vmin").isNull(), -50.0).otherwise(F.col("vmin")), "vmax": F.when(F.col("vmax").isNull(), 50.0).otherwise(F.col("vmax"))})
    elif value_range:
        ranged = frames.withColumns({"vmin": F.lit(value_range[0]), "vmax": F.lit(value_range[1])})
    else:
        ranged = stats.auto_scale(frames, animation or ["grid_id"])
    return ranged.withColumns({"py": F.lit(height - 1) - F.col("row"), "idx": colour_index(F.col("value"), F.col("vmin"), F.col("vmax"), n, log)})


def render(cells: DataFrame, axes: DataFrame, boxes: DataFrame, frames: DataFrame, height: int, n: int = MOST_COLOURS) -> DataFrame:
    """The colour of every pixel of every frame, on the range of the pixels shown."""
    return render_frames(extract.map_frames(cells, axes, boxes, frames), height, n, animation=["grid_id", "layer_id"])
