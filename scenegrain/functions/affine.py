"""Axis-aligned affine transforms and grids, for numbers and as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(t) -> tuple[float, float, float, float]:
    """(sx, tx, sy, ty) of a 4-tuple, or of a 6-tuple (a, b, c, d, e, f) without rotation."""
    t = [float(v) for v in t]
    if len(t) == 4:
        return tuple(t)
    if len(t) == 6:
        a, b, c, d, e, f = t
        if b or d:
            raise ValueError("rotated or sheared transforms are not supported")
        return a, c, e, f
    raise ValueError("a transform has four or six values")


def normalise_column(t: Column) -> Column:
    """The same for an array column; null for other sizes, an error for rotation."""
    sheared = (t[1] != 0) | (t[3] != 0)
    six = F.when(sheared, F.raise_error(F.lit("rotated or sheared transforms are not supported")).cast("array<double>")).otherwise(F.array(t[0], t[2], t[4], t[5]))
    return F.when(F.size(t) == 4, t).when(F.size(t) == 6, six)


def target_grid(bounds, res: tuple[float, float]) -> tuple[tuple[float, float, float, float], int, int]:
    """North-up transform, height and width of bounds at a resolution: as many whole pixels as cover them."""
    x0, y0, x1, y1 = bounds
    return (res[0], x0, -res[1], y1), max(1, math.ceil((y1 - y0) / res[1])), max(1, math.ceil((x1 - x0) / res[0]))


def merge_shape(bounds, res: tuple[float, float]) -> tuple[int, int]:
    """Height and width of a query grid: rounded, halves to even."""
    x0, y0, x1, y1 = bounds
    return round((y1 - y0) / res[1]), round((x1 - x0) / res[0])


def suggested_grid(width: int, height: int, t, source: int, target: int):
    """A target grid that keeps the number of pixels on the diagonal; an approximation of common warpers, not bit-equal to any."""
    from scenegrain.functions.crs import transform_bbox

    sx, tx, sy, ty = normalise(t)
    box = (min(tx, tx + width * sx), min(ty, ty + height * sy), max(tx, tx + width * sx), max(ty, ty + height * sy))
    x0, y0, x1, y1 = transform_bbox(box, source, target)
    res = math.hypot(x1 - x0, y1 - y0) / math.hypot(width, height)
    return target_grid((x0, y0, x1, y1), (res, res))


def bounds_columns(sx: Column, tx: Column, sy: Column, ty: Column, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """Map bounds of a raster of either orientation."""
    xa, ya = tx + width * sx, ty + height * sy
    return F.least(tx, xa), F.least(ty, ya), F.greatest(tx, xa), F.greatest(ty, ya)


def target_shape_columns(bounds: tuple[Column, Column, Column, Column], res: tuple[float, float]) -> tuple[Column, Column]:
    """Height and width of ``target_grid`` for columns of bounds."""
    x0, y0, x1, y1 = bounds
    n = lambda lo, hi, r: F.greatest(F.lit(1), F.ceil((hi - lo) / r).cast("long"))
    return n(y0, y1, res[1]), n(x0, x1, res[0])


def merge_shape_columns(bounds: tuple[Column, Column, Column, Column], res: tuple[float, float]) -> tuple[Column, Column]:
    """``merge_shape`` for columns of bounds."""
    x0, y0, x1, y1 = bounds
    return F.rint((y1 - y0) / res[1]).cast("long"), F.rint((x1 - x0) / res[0]).cast("long")


def patch_box_columns(x: Column, y: Column, size: float) -> tuple[Column, Column, Column, Column]:
    """The square of a side around the nearest point of a grid of that step."""
    cx, cy = F.rint(x / size) * size, F.rint(y / size) * size
    return cx - size / 2, cy - size / 2, cx + size / 2, cy + size / 2
