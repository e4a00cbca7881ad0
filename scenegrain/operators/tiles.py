"""Planning of tiles and byte ranges as column expressions and windows.

A tile is named by (row, column) in a raster's grid; a transform is (sx, tx, sy, ty), of either orientation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid_shape(size: Column, tile: Column) -> Column:
    """Tiles along a side."""
    return F.ceil(size / tile).cast("int")


def pixel_range(lo: Column, hi: Column, origin: Column, scale: Column, size: Column) -> tuple[Column, Column]:
    """First and last pixel of a map interval along one axis, clamped to the raster (first > last: none)."""
    a, b = (lo - origin) / scale, (hi - origin) / scale
    return F.greatest(F.lit(0), F.floor(F.least(a, b))).cast("int"), F.least(size - 1, F.ceil(F.greatest(a, b)) - 1).cast("int")


def tiles_of_box(df: DataFrame, box: Sequence[Column]) -> DataFrame:
    """One row per tile that meets the box: adds ``tile_row`` and ``tile_col``.

    ``df`` has sx, tx, sy, ty, width, height, tile_w, tile_h. A zero scale is an error.
    """
    x0, y0, x1, y1 = box
    c = F.col
    sx = F.when(c("sx") != 0, c("sx")).otherwise(F.raise_error(F.lit("zero pixel scale")).cast("double"))
    sy = F.when(c("sy") != 0, c("sy")).otherwise(F.raise_error(F.lit("zero pixel scale")).cast("double"))
    c0, c1 = pixel_range(x0, x1, c("tx"), sx, c("width"))
    r0, r1 = pixel_range(y0, y1, c("ty"), sy, c("height"))
    d = df.withColumns({"c0_": c0, "c1_": c1, "r0_": r0, "r1_": r1}).filter("c0_ <= c1_ AND r0_ <= r1_")
    first = lambda p, t: F.floor(c(p) / c(t)).cast("int")
    d = d.withColumn("tile_row", F.explode(F.sequence(first("r0_", "tile_h"), first("r1_", "tile_h"))))
    d = d.withColumn("tile_col", F.explode(F.sequence(first("c0_", "tile_w"), first("c1_", "tile_w"))))
    return d.drop("c0_", "c1_", "r0_", "r1_")


def window_of_box(box: Sequence[Column], clip: bool = True) -> dict[str, Column]:
    """Pixel window of a box: floor of the start, ceiling of the stop, cut to the raster if ``clip``."""
    x0, y0, x1, y1 = box
    c = F.col
    out = {}
    for n, lo, hi, o, s, size in (("row", y0, y1, "ty", "sy", "height"), ("col", x0, x1, "tx", "sx", "width")):
        a, b = (lo - c(o)) / c(s), (hi - c(o)) / c(s)
        start, stop = F.floor(F.least(a, b)).cast("int"), F.ceil(F.greatest(a, b)).cast("int")
        out[f"{n}_start"] = F.greatest(start, F.lit(0)) if clip else start
        out[f"{n}_stop"] = F.least(stop, c(size)) if clip else stop
    return out


def point_pixels(x: Column, y: Column) -> dict[str, Column]:
    """``row``, ``col`` and their fractions, ``in_bounds``, ``tile_row``, ``tile_col`` of a point; -1 for tiles out of bounds."""
    c = F.col
    cf, rf = (x - c("tx")) / c("sx"), (y - c("ty")) / c("sy")
    row, col = F.floor(rf).cast("int"), F.floor(cf).cast("int")
    ok = (row >= 0) & (col >= 0) & (row < c("height")) & (col < c("width"))
    tile = lambda p, t: F.when(ok, F.floor(p / c(t)).cast("int")).otherwise(-1)
    return {"row": row, "col": col, "row_f": rf, "col_f": cf, "in_bounds": ok, "tile_row": tile(row, "tile_h"), "tile_col": tile(col, "tile_w")}


def tile_bytes(offsets: Column, sizes: Column, tile_row: Column, tile_col: Column, tiles_x: Column) -> tuple[Column, Column]:
    """Offset and size of a tile; null beyond the tables, or where they differ in length."""
    at = tile_row * tiles_x + tile_col
    ok = (F.size(offsets) == F.size(sizes)) & (at >= 0) & (at < F.size(offsets))
    return F.when(ok, F.get(offsets, at)), F.when(ok, F.get(sizes, at))


def merge_ranges(requests: DataFrame, key: Sequence[str], start: str, stop: str, gap: int = 1024) -> DataFrame:
    """Adds ``range``, the number of the merged byte range within ``key`` (from 0): a request joins the range before if it starts at most ``gap`` after its end."""
    w = Window.partitionBy(*key).orderBy(start, stop)
    before = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = requests.withColumn("new_", F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0))
    return flagged.withColumn("range", (F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")).drop("new_")


def merged(requests: DataFrame, key: Sequence[str], start: str, stop: str, gap: int = 1024) -> DataFrame:
    """One row per merged range: its start, stop and number of requests."""
    return merge_ranges(requests, key, start, stop, gap).groupBy(*key, "range").agg(F.min(start).alias(start), F.max(stop).alias(stop), F.count("*").alias("requests"))


def coverage(canvas_row: Column, canvas_col: Column) -> Column:
    """A pixel of a tile-aligned canvas is a real one."""
    return (canvas_row < F.col("height")) & (canvas_col < F.col("width")) & (canvas_row >= 0) & (canvas_col >= 0)


def pixels_of_tiles(tiles: DataFrame, pixels: str = "pixels") -> DataFrame:
    """Explode decoded tiles (row-major arrays) into pixels with ``row`` and ``col`` in the raster; padding beyond the raster is left out."""
    d = tiles.select("*", F.posexplode(pixels).alias("pos_", "value")).drop(pixels)
    c = F.col
    d = d.withColumns({"row": (c("tile_row") * c("tile_h") + F.floor(c("pos_") / c("tile_w"))).cast("int"), "col": (c("tile_col") * c("tile_w") + c("pos_") % c("tile_w")).cast("int")}).drop("pos_")
    return d.filter(coverage(c("row"), c("col")))


def ring_offsets(radius: int) -> list[tuple[int, int]]:
    """(dr, dc) of a Chebyshev ring: top row, bottom row, left and right column."""
    if radius < 1:
        return []
    line, side = range(-radius, radius + 1), range(1 - radius, radius)
    return [(-radius, c) for c in line] + [(radius, c) for c in line] + [(r, -radius) for r in side] + [(r, radius) for r in side]


def square_offsets(radius: int) -> list[tuple[int, int]]:
    """(dr, dc) of a full square, row by row."""
    if radius < 0:
        raise ValueError("radius must not be negative")
    line = range(-radius, radius + 1)
    return [(r, c) for r in line for c in line]


def is_nodata(value: Column, nodata: Column) -> Column:
    """NaN always is; null values are too."""
    return value.isNull() | F.isnan(value) | F.coalesce(value == nodata, F.lit(False))
