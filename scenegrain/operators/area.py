"""Area reads, mosaics and stacks over tables of records and decoded tiles (see ``points`` for their columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenegrain.operators.range_join import overlap_join
from scenegrain.operators.tiles import is_nodata, pixels_of_tiles, tiles_of_box, window_of_box


def area_pixels(records: DataFrame, aois: DataFrame, tiles: DataFrame, mask: bool = True, cell: float = 8.0, touching: bool = True) -> DataFrame:
    """Pixels of each (record, AOI): ``row``, ``col``, ``value``, ``valid``.

    ``aois`` has ``geometry_id`` and a box ``aoi``. Pixels lie in the AOI's window; with ``mask`` only those count
    whose centre is in the AOI (lower and left border in, upper and right out). Only tiles that meet it are read.
    """
    c = F.col
    b = c("aoi")
    box = [b["xmin"], b["ymin"], b["xmax"], b["ymax"]]
    j = overlap_join(records, aois, "bbox", "aoi", cell, touching=touching)
    j = j.withColumns(window_of_box(box)).filter("row_start < row_stop AND col_start < col_stop")
    need = tiles_of_box(j, box).join(tiles, ["record", "tile_row", "tile_col"])
    p = pixels_of_tiles(need).filter("row >= row_start AND row < row_stop AND col >= col_start AND col < col_stop")
    x, y = c("tx") + (c("col") + 0.5) * c("sx"), c("ty") + (c("row") + 0.5) * c("sy")
    inside = (x >= box[0]) & (x < box[2]) & (y >= box[1]) & (y < box[3])
    return p.withColumn("inside", inside if mask else F.lit(True)).withColumn("valid", F.col("inside") & ~is_nodata(c("value"), c("nodata")))


def fill_value(explicit: float | None, nodata: Column) -> Column:
    """Explicit fill, else nodata, else 0."""
    return F.coalesce(F.lit(explicit).cast("double"), nodata.cast("double"), F.lit(0.0))


def area_frame(pixels: DataFrame, explicit_fill: float | None = None) -> DataFrame:
    """One row per (record, geometry_id): height, width and the masked, filled window as a row-major array, with the number of valid pixels."""
    v = F.when(F.col("inside"), F.col("value")).otherwise(fill_value(explicit_fill, F.col("nodata")))
    g = pixels.groupBy("record", "geometry_id", "row_start", "row_stop", "col_start", "col_stop")
    data = F.transform(F.array_sort(F.collect_list(F.struct("row", "col", v.alias("v")))), lambda x: x.v)
    out = g.agg(data.alias("data"), F.count_if("valid").alias("n_valid"), F.count("*").alias("n"))
    h, w = (F.col(f"{k}_stop") - F.col(f"{k}_start") for k in ("row", "col"))
    return out.select("record", "geometry_id", h.alias("height"), w.alias("width"), "data", "n_valid", (F.col("n") == h * w).alias("complete"))


def zonal(pixels: DataFrame) -> DataFrame:
    """Statistics of the valid pixels of each (record, geometry_id)."""
    v = F.when(F.col("valid"), F.col("value"))
    return pixels.groupBy("record", "geometry_id").agg(F.count(v).alias("n"), F.min(v).alias("lowest"), F.max(v).alias("highest"), F.sum(v).alias("total"))


def map_pixels(records: DataFrame, tiles: DataFrame) -> DataFrame:
    """All pixels with their place on the common unit grid (``gx``, ``gy``), for records aligned to it."""
    p = pixels_of_tiles(tiles.join(records, "record"))
    c = F.col
    gx = F.floor(c("tx") / F.abs(c("sx")) + c("col") * F.signum(c("sx")) + F.when(c("sx") < 0, -1).otherwise(0))
    gy = F.floor(c("ty") / F.abs(c("sy")) + c("row") * F.signum(c("sy")) + F.when(c("sy") < 0, -1).otherwise(0))
    return p.withColumns({"gx": gx.cast("long"), "gy": gy.cast("long"), "valid": ~is_nodata(c("value"), c("nodata"))})


def first_valid(pixels: DataFrame, order: list[str], empty: float = 0.0) -> DataFrame:
    """The mosaic: at each place the first valid value in record order; ``empty`` where there is none."""
    rank = F.struct(*order)
    return pixels.groupBy("gx", "gy").agg(F.coalesce(F.min_by("value", F.when(F.col("valid"), rank)), F.lit(empty)).alias("value"))


def combine_first(pixels: DataFrame, order: list[str]) -> DataFrame:
    """At each place the first value that isn't nodata in record order, else null."""
    return pixels.groupBy("gx", "gy").agg(F.min_by("value", F.when(F.col("valid"), F.struct(*order))).alias("value"))


def merge_strict(pixels: DataFrame) -> DataFrame:
    """The one valid value at each place; records that disagree are an error."""
    v = F.when(F.col("valid"), F.col("value"))
    g = pixels.groupBy("gx", "gy").agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    return g.select("gx", "gy", F.when(F.col("lo") < F.col("hi"), F.raise_error(F.lit("records disagree")).cast("double")).otherwise(F.col("lo")).alias("value"))


def last_wins(pixels: DataFrame, order: list[str]) -> DataFrame:
    """Later records overwrite earlier ones, nodata too."""
    return pixels.groupBy("gx", "gy").agg(F.max_by("value", F.struct(*order)).alias("value"))


def mean_of_overlaps(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("gx", "gy").agg(F.avg(F.when(F.col("valid"), F.col("value"))).alias("value"))


def on_grid(pixels: DataFrame, chips: DataFrame, size: int, fill: float = 0.0) -> DataFrame:
    """Aligned nearest resampling onto chips (chip, cx, cy: lower left place): every place of a chip, filled where no record has a pixel."""
    c = F.col
    spot = F.explode(F.sequence(F.lit(0), F.lit(size * size - 1)))
    grid = chips.select("chip", spot.alias("s_"), "cx", "cy").select("chip", (c("cx") + c("s_") % size).cast("long").alias("gx"), (c("cy") + F.floor(c("s_") / size)).cast("long").alias("gy"))
    return grid.join(pixels, ["gx", "gy"], "left").withColumn("value", F.coalesce("value", F.lit(fill)))


def time_order(df: DataFrame, time: str, ty: str = "sy") -> DataFrame:
    """Adds ``t``, the rank in time from 0, and whether the rows of the array must be turned to run north to south."""
    times = df.select(time).distinct()
    ranked = times.withColumn("t", F.row_number().over(Window.orderBy(time)) - 1)  # distinct moments only
    return df.join(ranked, time).withColumn("flip", F.col(ty) > 0)


def first_readable(df: DataFrame, key: list[str], order: list[str], readable: Column, value: str) -> DataFrame:
    """The value of the first readable record of each group; null if none is."""
    return df.groupBy(*key).agg(F.min_by(value, F.when(readable, F.struct(*order))).alias(value))
