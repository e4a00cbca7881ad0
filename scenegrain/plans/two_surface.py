"""Planning over a narrow index and a wide table of the same records, and narrowing by areas of interest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenegrain.functions.crs import transform_bbox


def restrict(wide: DataFrame, index: DataFrame | None) -> DataFrame:
    """The wide rows whose id, and data shard where both have it, the index still holds.

    A left semi join: Spark broadcasts the index side only if its measured size allows, and prunes
    partitions dynamically where ``source_part`` is one.
    """
    if index is None:
        return wide
    keys = ["id", *(["source_part"] if "source_part" in index.columns and "source_part" in wide.columns else [])]
    return wide.join(index.select(*keys).distinct(), keys, "left_semi")


def open_shards(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """Only the data files that a filtered index names in ``source_part``, opened as one table, restricted to its ids.

    The list of files is bounded by the files there are; an index that names none gives an empty table.
    """
    parts = [r[0] for r in index.select("source_part").filter("source_part IS NOT NULL").distinct().orderBy("source_part").collect()]
    at = folder.rstrip("/")
    if not parts:
        return spark.read.parquet(at).limit(0)
    return spark.read.parquet(*[f"{at}/{p}" for p in parts]).join(index.select("id").distinct(), "id", "left_semi")


def intersect(a: Sequence[float] | None, b: Sequence[float] | None) -> tuple[float, ...] | None:
    """Of two boxes; None stands for no limit. Raises ValueError if they are disjoint."""
    if a is None or b is None:
        both = a if b is None else b
        return None if both is None else tuple(both)
    x = (max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3]))
    if x[0] > x[2] or x[1] > x[3]:
        raise ValueError("disjoint")
    return x


def aoi_bounds(aois: DataFrame, box: str = "bbox", epsg: int = 4326) -> tuple[float, ...] | None:
    """Bounds of all areas in lon/lat: one row to the driver, a literal for the scan."""
    b = F.col(box)
    r = aois.agg(F.min(b.xmin), F.min(b.ymin), F.max(b.xmax), F.max(b.ymax)).first()
    if r[0] is None:
        return None
    return tuple(r) if epsg == 4326 else transform_bbox(tuple(r), epsg, 4326)


def narrow(records: DataFrame, aois: DataFrame, user_bbox: Sequence[float] | None = None, box: str = "bbox", epsg: int = 4326) -> DataFrame:
    """Records filtered by the areas' bounds and the user's box, pushed into the scan; provably disjoint ones are never read."""
    from scenegrain.functions.predicates import bbox_overlaps

    try:
        q = intersect(aoi_bounds(aois, box, epsg), user_bbox)
    except ValueError:
        return records.filter(F.lit(False))
    return records if q is None else records.filter(bbox_overlaps(q))
