"""Chips: time slices, strides and windows over records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenegrain.functions.predicates import _ntz, moment
from scenegrain.operators.ids import numbered


def in_slice(t: Column, start: str, stop: str) -> Column:
    """A point in time lies in (start, stop]; where both are equal, at that moment."""
    a, b = moment(start), moment(stop)
    return t == _ntz(a) if a == b else (t > _ntz(a)) & (t <= _ntz(b))


def stride(df: DataFrame, order: Sequence[str], step: int) -> DataFrame:
    """Every ``step``-th row in order, the first one first."""
    return numbered(df, order, "k_").filter(F.col("k_") % step == 0).drop("k_")


def grid_chips(spark, roi: Sequence[float], size: float, step: float) -> DataFrame:
    """Rows (chip, xmin, ymin, xmax, ymax) of windows of a size over a region, at a stride."""
    x0, y0, x1, y1 = roi
    nx, ny = (max(0, int((hi - lo - size) // step) + 1) for lo, hi in ((x0, x1), (y0, y1)))
    i, j = F.col("id") % max(nx, 1), F.floor(F.col("id") / max(nx, 1))
    xmin, ymin = i * step + x0, j * step + y0
    return spark.range(nx * ny).select(F.col("id").alias("chip"), xmin.alias("xmin"), ymin.alias("ymin"), (xmin + size).alias("xmax"), (ymin + size).alias("ymax"))


def label_value(v):
    """A label as a model takes it: whole numbers as int, others as float, NaN as None."""
    import math

    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return int(v) if isinstance(v, (bool, int)) or (hasattr(v, "dtype") and v.dtype.kind in "iub") else float(v)
