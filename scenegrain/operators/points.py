"""Sampling rasters at points, over tables of records and of decoded tiles.

``points``: point_index, x, y and any more. ``records``: record, seq (order of the scan), datetime, bbox, sx, tx,
sy, ty, width, height, tile_w, tile_h, nodata. ``tiles``: record, tile_row, tile_col, pixels (row-major array).

Points without a place, records without a box and pixels outside a raster give no rows. A point's record is
decided by its box; with ``latest`` a winner whose pixel is outside its raster is not replaced by an older one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenegrain.operators.range_join import points_in_boxes
from scenegrain.operators.tiles import is_nodata, point_pixels, ring_offsets, square_offsets

MATCHES = ("all", "latest")
NEIGHBOURHOODS = ("off", "always", "if_center_nodata")


def candidates(points: DataFrame, records: DataFrame, match: str = "all", cell: float = 1.0) -> DataFrame:
    """Points with the records whose box holds them; for ``latest`` the newest only (no time is oldest, then scan order), before any pixel is read."""
    j = points_in_boxes(points, records, "x", "y", "bbox", cell)
    if match == "latest":
        # pre-aggregated on the map side: one struct a point, however many records cover it
        best = F.max_by(F.struct(*j.columns), F.struct(F.coalesce(F.col("datetime"), F.lit("0001-01-01").cast("timestamp_ntz")), -F.col("seq")))
        j = j.groupBy("point_index").agg(best.alias("b_")).select("b_.*")
    return j.withColumns(point_pixels(F.col("x"), F.col("y"))).filter("in_bounds").drop("in_bounds")


def _read(at: DataFrame, tiles: DataFrame, row: str, col: str, how: str) -> DataFrame:
    """Join pixels by tile, reading each tile once: adds ``v_``."""
    c = F.col
    at = at.withColumns({"tr_": F.floor(c(row) / c("tile_h")).cast("int"), "tc_": F.floor(c(col) / c("tile_w")).cast("int")})
    t = tiles.select(c("record").alias("r_"), c("tile_row").alias("a_"), c("tile_col").alias("b_"), c("pixels").alias("p_"))
    j = at.join(t, (c("record") == c("r_")) & (c("tr_") == c("a_")) & (c("tc_") == c("b_")), how)
    return j.withColumn("v_", F.get("p_", (c(row) % c("tile_h")) * c("tile_w") + c(col) % c("tile_w")).cast("double")).drop("tr_", "tc_", "r_", "a_", "b_", "p_")


def rect_distance_sq(row: str, col: str):
    """Squared map distance from the point to a pixel's rectangle."""
    c = F.col
    gap = lambda p, f: F.greatest(p - f, f - p - 1, F.lit(0.0))
    return F.pow(gap(c(row), c("row_f")) * F.abs(c("sy")), 2) + F.pow(gap(c(col), c("col_f")) * F.abs(c("sx")), 2)


def sample(points: DataFrame, records: DataFrame, tiles: DataFrame, match: str = "all", max_distance: int = 0, neighbourhood: str = "off", cell: float = 1.0) -> DataFrame:
    """Rows per (point, record) whose tile was read: ``value``, nodata kept as it is unless a valid pixel lies within ``max_distance`` pixels.

    The fallback takes the nearest valid pixel of the smallest ring that has one, then the first in ring order.
    ``neighbourhood_values``: the (2 max_distance + 1)^2 window in row-major order, NaN outside or unread.
    """
    if match not in MATCHES or neighbourhood not in NEIGHBOURHOODS:
        raise ValueError(f"match is one of {MATCHES}, neighbourhood one of {NEIGHBOURHOODS}")
    if max_distance < 0 or (neighbourhood != "off" and max_distance == 0):
        raise ValueError("max_distance must not be negative, and a neighbourhood needs it above 0")
    base = _read(candidates(points, records, match, cell), tiles, "row", "col", "inner").withColumnRenamed("v_", "value")
    if max_distance == 0:
        return base
    empty = is_nodata(F.col("value"), F.col("nodata"))
    key = ["point_index", "record"]
    out = base.withColumn("center_nodata", empty)
    offsets = [(r, k, dr, dc) for r in range(1, max_distance + 1) for k, (dr, dc) in enumerate(ring_offsets(r))]
    ring = F.array(*[F.struct(F.lit(r).alias("radius"), F.lit(k).alias("k"), F.lit(a).alias("dr"), F.lit(b).alias("dc")) for r, k, a, b in offsets])
    near = out.filter("center_nodata").select(*key, "row", "col", "row_f", "col_f", "sx", "sy", "width", "height", "tile_w", "tile_h", "nodata", F.explode(ring).alias("o"))
    near = near.withColumns({"r2": F.col("row") + F.col("o.dr"), "c2": F.col("col") + F.col("o.dc")}).filter("r2 >= 0 AND c2 >= 0 AND r2 < height AND c2 < width")
    near = _read(near, tiles, "r2", "c2", "inner").filter(~is_nodata(F.col("v_"), F.col("nodata")))
    rank = F.struct(F.col("o.radius").alias("radius"), rect_distance_sq("r2", "c2").alias("d"), F.col("o.k").alias("k"))
    found = near.groupBy(*key).agg(F.min_by("v_", rank).alias("found_"))
    out = out.join(found, key, "left").withColumn("value", F.coalesce("found_", "value")).drop("found_")
    if neighbourhood == "off":
        return out
    square = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(a).alias("dr"), F.lit(b).alias("dc")) for i, (a, b) in enumerate(square_offsets(max_distance))])
    which = out if neighbourhood == "always" else out.filter("center_nodata")
    w = which.select(*key, "row", "col", "width", "height", "tile_w", "tile_h", F.explode(square).alias("o")).withColumns({"r2": F.col("row") + F.col("o.dr"), "c2": F.col("col") + F.col("o.dc")})
    inside = F.expr("r2 >= 0 AND c2 >= 0 AND r2 < height AND c2 < width")
    w = _read(w, tiles, "r2", "c2", "left").withColumn("v_", F.when(inside, F.coalesce("v_", F.lit(float("nan")))).otherwise(F.lit(float("nan"))))
    lists = w.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("o.k").alias("k"), F.col("v_").alias("v")))), lambda x: x.v).alias("neighbourhood_values"))
    return out.join(lists, key, "left")


def to_contract(sampled: DataFrame, band: str, point_crs: int = 4326, raster_crs: int | None = None, metadata: list[str] = ()) -> DataFrame:
    """The columns of a sample table by name and type, then the points' own."""
    c = F.col
    out = [
        c("point_index").cast("long"), c("x").cast("double").alias("point_x"), c("y").cast("double").alias("point_y"), F.lit(point_crs).cast("int").alias("point_crs"),
        c("record").cast("string").alias("record_id"), c("datetime"), (c("collection") if "collection" in sampled.columns else F.lit("")).cast("string").alias("collection"),
        F.lit(band).alias("band"), c("value").cast("double"), F.lit(raster_crs).cast("int").alias("raster_crs"),
    ]
    clash = {"point_x", "point_y", "point_crs", "record_id", "band", "value", "raster_crs"} & set(metadata)
    if clash:
        raise ValueError(f"point columns collide with result columns: {sorted(clash)}")
    extra = ["neighbourhood_values"] if "neighbourhood_values" in sampled.columns else []
    return sampled.select(*out, *extra, *metadata)
