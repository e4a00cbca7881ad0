"""Joins of boxes by overlap, through a grid, so that they scale to any number of boxes on either side."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenegrain.operators.joins import salted_join


def _cells(lo: Column, hi: Column, cell: float) -> Column:
    return F.sequence(F.floor(lo / cell).cast("long"), F.floor(hi / cell).cast("long"))


def _spread(df: DataFrame, box: Column, cell: float) -> DataFrame:
    whole = box.isNotNull() & (box["xmin"] <= box["xmax"]) & (box["ymin"] <= box["ymax"])
    d = df.filter(whole).withColumn("cx_", F.explode(_cells(box["xmin"], box["xmax"], cell)))
    return d.withColumn("cy_", F.explode(_cells(box["ymin"], box["ymax"], cell)))


def overlap_join(left: DataFrame, right: DataFrame, left_box: str, right_box: str, cell: float = 1.0, touching: bool = True) -> DataFrame:
    """Pairs of rows whose boxes overlap, once each; ``touching`` decides whether a common edge does.

    A pair that shares several cells is kept only in the cell of its overlap's lower left corner, so no
    distinct is needed.
    """
    l, r = F.col(left_box), F.col(right_box)
    j = salted_join(_spread(left, l, cell), _spread(right, r, cell), ["cx_", "cy_"])
    x0, y0 = F.greatest(l["xmin"], r["xmin"]), F.greatest(l["ymin"], r["ymin"])
    x1, y1 = F.least(l["xmax"], r["xmax"]), F.least(l["ymax"], r["ymax"])
    meets = (x0 <= x1) & (y0 <= y1) if touching else (x0 < x1) & (y0 < y1)
    first = (F.floor(x0 / cell) == F.col("cx_")) & (F.floor(y0 / cell) == F.col("cy_"))
    return j.filter(meets & first).drop("cx_", "cy_")


def overlap_semi_join(records: DataFrame, aois: DataFrame, cell: float = 1.0) -> DataFrame:
    """The records whose box overlaps any AOI's, each row once."""
    a = aois.select(F.col("bbox").alias("aoi_")).filter("aoi_ IS NOT NULL").distinct()
    boxes = records.select(F.col("bbox").alias("b_")).distinct()  # the answer depends on the box alone
    hit = overlap_join(boxes, a, "b_", "aoi_", cell).select("b_").distinct()
    return records.join(hit, records["bbox"] == hit["b_"], "left_semi")


def points_in_boxes(points: DataFrame, records: DataFrame, x: str, y: str, box: str, cell: float = 1.0) -> DataFrame:
    """Pairs of points and the rows whose box holds them, borders included: a point lies in one cell only."""
    p = points.withColumn("cx_", F.floor(F.col(x) / cell).cast("long")).withColumn("cy_", F.floor(F.col(y) / cell).cast("long"))
    b = F.col(box)
    j = salted_join(p, _spread(records, b, cell), ["cx_", "cy_"])
    return j.filter((F.col(x) >= b["xmin"]) & (F.col(x) <= b["xmax"]) & (F.col(y) >= b["ymin"]) & (F.col(y) <= b["ymax"])).drop("cx_", "cy_")


def footprint_join(left: DataFrame, right: DataFrame, left_geometry: str, right_geometry: str, left_box: str, right_box: str, cell: float = 1.0, how: str = "intersects") -> DataFrame:
    """Pairs of rows whose footprints (WKB) share a point, or with ``how="covers"`` whose left one covers the right one; unreadable ones pair with nothing.

    Boxes pair first, through the grid; then footprints are tested exactly, each distinct text of a batch parsed once.
    """
    from scenegrain.functions import polygons, wkb

    test = {"intersects": polygons.intersects, "covers": polygons.covers}[how]

    @F.arrow_udf("boolean")
    def exact(a: pa.Array, b: pa.Array) -> pa.Array:
        memo: dict = {}
        read = lambda g: memo[g] if g in memo else memo.setdefault(g, None if g is None else wkb.parse(g))
        known: dict = {}
        out = []
        for pair in zip(a.to_pylist(), b.to_pylist()):
            if pair not in known:
                p, q = read(pair[0]), read(pair[1])
                known[pair] = p is not None and q is not None and test(p, q)
            out.append(known[pair])
        return pa.array(out, pa.bool_())

    j = overlap_join(left, right, left_box, right_box, cell)
    return j.filter(exact(F.col(left_geometry), F.col(right_geometry)))
