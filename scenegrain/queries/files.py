"""Reads of real files: the rasters of ``pixels`` written as tiled GeoTIFFs, opened through a collection."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenegrain import catalog, read
from scenegrain.collection import Collection
from scenegrain.functions import crs, geometry
from scenegrain.ingest import enrich
from scenegrain.ingest.normalize import ASSETS, box_wkb
from scenegrain.operators import labelled
from scenegrain.queries.pixels import _FALL, _SQUARE, _VALUE, AOIS, BASE, PIX, RECS, _aois, _archive, _points
from scenegrain.session import scratch_path
from scenegrain.tiff.header import parse_headers

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _samples(spark, d, **kw):
    return _archive(spark, d).sample_points(_points(spark, d).drop("c_mktsegment"), ["B1"], index="point_index", cell=8.0, **kw)


# ---- points ---------------------------------------------------------------------------------------------


@query(f"WITH {BASE}, win AS (SELECT * FROM base QUALIFY row_number() OVER (PARTITION BY point_index ORDER BY dt DESC, rec) = 1) SELECT point_index, CAST(rec AS VARCHAR) AS record_id, value FROM win JOIN pix USING (rec, row, col)")
def pt03_files_latest(spark, d):
    return _samples(spark, d, match="latest").select("point_index", "record_id", "value")


@query(f"WITH {_FALL} SELECT b.point_index, CAST(b.rec AS VARCHAR) AS record_id, coalesce(best.value, b.value) AS value FROM b LEFT JOIN best USING (point_index, rec)")
def pt05_files_fallback(spark, d):
    """The fallback looks across tiles of 8 x 8 pixels."""
    return _samples(spark, d, max_distance=2).select("point_index", "record_id", "value")


@query(f"""WITH {BASE}, b AS (SELECT * {_VALUE}) SELECT b.point_index, CAST(b.rec AS VARCHAR) AS record_id, string_agg(coalesce(CAST(CAST(pix.value AS INT) AS VARCHAR), 'x'), ',' ORDER BY k) AS hood
FROM b CROSS JOIN (VALUES {_SQUARE}) o(k, dr, dc) LEFT JOIN pix ON pix.rec = b.rec AND pix.row = b.row + dr AND pix.col = b.col + dc GROUP BY ALL""")
def pt08_files_neighbourhood(spark, d):
    s = _samples(spark, d, max_distance=1, neighbourhood="always")
    text = F.array_join(F.transform("neighbourhood_values", lambda v: F.when(F.isnan(v), "x").otherwise(v.cast("int").cast("string"))), ",")
    return s.select("point_index", "record_id", text.alias("hood"))


@query(f"WITH {BASE} SELECT point_index, CAST(rec AS VARCHAR) AS record_id, CASE WHEN rec % 5 > 0 THEN value END AS value, rec % 5 = 0 AS failed FROM base LEFT JOIN pix USING (rec, row, col) WHERE rec % 5 = 0 OR value IS NOT NULL")
def pt13_files_errors(spark, d):
    """Every fifth file is gone: its points are rows with an error."""
    c = _archive(spark, d)
    gone = F.transform_values("assets", lambda k, v: F.struct(F.when(F.col("id").cast("long") % 5 == 0, F.concat(v["href"], F.lit(".gone"))).otherwise(v["href"]).alias("href"), v["band_index"].alias("band_index")))
    c = Collection(c.df.withColumn("assets", gone.cast(ASSETS)), c.name)
    s = c.sample_points(_points(spark, d).select("point_index", "x", "y"), ["B1"], index="point_index", cell=8.0, errors=True)
    return s.select("point_index", "record_id", "value", F.col("error").isNotNull().alias("failed"))


# ---- headers --------------------------------------------------------------------------------------------


def _stored(spark, d):
    c = _archive(spark, d)
    return Collection(enrich.enrich(c.df, ["B1"]), c.name)


@query(f"WITH {RECS} SELECT CAST(rec AS VARCHAR) AS id, 16 AS width, 8 AS tile, 'int16' AS dtype, tx, ty, -9999.0 AS nodata, 4 AS tiles, 4326 AS epsg, 8 AS compression, 2 AS predictor FROM recs")
def sc21_headers(spark, d):
    u = enrich.url_index(_archive(spark, d).df, "id", ["B1"])
    h = F.col("header")
    j = u.join(parse_headers(u.select("href").distinct()), "href")
    return j.select(F.col("record").alias("id"), h.image_width.alias("width"), h.tile_height.alias("tile"), h.dtype.alias("dtype"), h["transform"][1].alias("tx"), h["transform"][3].alias("ty"), h.nodata.alias("nodata"), F.size(h.tile_offsets).alias("tiles"), h.epsg.alias("epsg"), h.compression.alias("compression"), h.predictor.alias("predictor"))


@query(f"WITH {RECS} SELECT CAST(rec AS VARCHAR) AS id, 'EPSG:4326' AS crs, 4326 AS epsg, 16 AS height, 1 AS samples FROM recs")
def nm17_enrich(spark, d):
    m = F.col("B1_metadata")
    return _stored(spark, d).df.select("id", "crs", F.col("`proj:epsg`").alias("epsg"), m.image_height.alias("height"), m.samples_per_pixel.alias("samples"))


@query(f"WITH {BASE} SELECT point_index, CAST(rec AS VARCHAR) AS record_id, value {_VALUE}")
def dc07_stored_headers(spark, d):
    """Points from headers that the collection holds: no file's header is read."""
    s = _stored(spark, d).sample_points(_points(spark, d).select("point_index", "x", "y"), ["B1"], index="point_index", cell=8.0)
    return s.select("point_index", "record_id", "value")


# ---- areas ----------------------------------------------------------------------------------------------


def _boxes(spark):
    b = F.col("aoi")
    return _aois(spark).select("geometry_id", box_wkb(b.xmin, b.ymin, b.xmax, b.ymax).alias("geometry"))


def _triangles(spark):
    """The lower left half of each AOI's box."""
    import struct as st

    b = F.col("aoi")

    @F.arrow_udf("binary")
    def triangle(x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array) -> pa.Array:
        rings = [[(a, b), (c, b), (a, e), (a, b)] for a, b, c, e in zip(*(v.to_pylist() for v in (x0, y0, x1, y1)))]
        return pa.array([st.pack("<BIII", 1, 3, 1, 4) + b"".join(st.pack("<dd", *p) for p in r) for r in rings], pa.binary())

    return _aois(spark).select("geometry_id", triangle(b.xmin, b.ymin, b.xmax, b.ymax).alias("geometry"))


@query(f"""WITH {RECS}, {PIX}, {AOIS}, p AS (SELECT rec, geometry_id, value, (tx + col + 0.5 - x0) / (x1 - x0) AS u, (ty - row - 0.5 - y0) / (y1 - y0) AS v FROM recs JOIN aois ON tx <= x1 AND tx + 16 >= x0 AND ty - 16 <= y1 AND ty >= y0 JOIN pix USING (rec))
SELECT CAST(rec AS VARCHAR) AS record, geometry_id, count(*) AS n, sum(value) AS total FROM p WHERE u >= 0 AND v >= 0 AND u + v < 1 AND value <> -9999 GROUP BY ALL""")
def px02_polygon_mask(spark, d):
    """Pixels whose centre lies in a triangle, its lower and left border included."""
    f = _archive(spark, d).area_frame(_triangles(spark), ["B1"], cell=8.0)
    return read.long_pixels(f).groupBy("record", "geometry_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(f"WITH {RECS}, {PIX}, {AOIS} SELECT CAST(rec AS VARCHAR) AS record, geometry_id, 16 AS height, 16 AS width, count(*) FILTER (value <> -9999) AS n, sum(value) FILTER (value <> -9999) AS total FROM recs JOIN aois ON tx < x1 AND tx + 16 > x0 AND ty - 16 < y1 AND ty > y0 JOIN pix USING (rec) GROUP BY ALL")
def px01_full_read(spark, d):
    """Whole rasters that meet an area."""
    f = _archive(spark, d).area_frame(_boxes(spark), ["B1"], cell=8.0, mode="full").filter("error IS NULL")
    n = read.long_pixels(f).groupBy("record", "geometry_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return f.select("record", "geometry_id", "height", "width").join(n, ["record", "geometry_id"])


@query(f"WITH {RECS}, {PIX}, {AOIS} SELECT CAST(rec AS VARCHAR) AS record, geometry_id, 32 AS height, 32 AS width, 4 * count(*) FILTER (value <> -9999) AS n, 4 * sum(value) FILTER (value <> -9999) AS total FROM recs JOIN aois ON tx < x1 AND tx + 16 > x0 AND ty - 16 < y1 AND ty > y0 JOIN pix USING (rec) GROUP BY ALL")
def px08_regridded(spark, d):
    """Whole rasters brought onto a grid of half their pixel's side."""
    f = _archive(spark, d).area_frame(_boxes(spark), ["B1"], cell=8.0, mode="full", to=(4326, 0.5)).filter("error IS NULL")
    n = read.long_pixels(f).groupBy("record", "geometry_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return f.select("record", "geometry_id", "height", "width").join(n, ["record", "geometry_id"])


@query(f"WITH {RECS}, {AOIS} SELECT CAST(rec AS VARCHAR) AS record, geometry_id, CAST(ceil(ty - y0) - floor(ty - y1) AS INT) AS height, CAST(ceil(x1 - tx) - floor(x0 - tx) AS INT) AS width, -9999.0 AS fill FROM recs JOIN aois ON tx < x1 AND tx + 16 > x0 AND ty - 16 < y1 AND ty > y0")
def px03_window_read(spark, d):
    """The area's window of every raster that it meets, filled outside the raster."""
    f = _archive(spark, d).area_frame(_boxes(spark), ["B1"], cell=8.0, mode="window").filter("error IS NULL")
    return f.select("record", "geometry_id", "height", "width", "fill")


_INSIDE = f"""{RECS}, {PIX}, {AOIS}, ins AS (SELECT rec, dt, geometry_id, CAST(tx AS BIGINT) + col AS gx, CAST(ty AS BIGINT) - row AS gy, value FROM recs JOIN aois ON tx <= x1 AND tx + 16 >= x0 AND ty - 16 <= y1 AND ty >= y0 JOIN pix USING (rec)
 WHERE value <> -9999 AND tx + col + 0.5 >= x0 AND tx + col + 0.5 < x1 AND ty - row - 0.5 >= y0 AND ty - row - 0.5 < y1)"""


def _summed(g: DataFrame, *keys: str) -> DataFrame:
    ok = F.filter("data", lambda x: ~F.isnan(x))
    return g.select(*keys, F.size(ok).cast("long").alias("n"), F.aggregate(ok, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(f"WITH {_INSIDE} SELECT geometry_id, count(*) AS n, sum(v) AS total FROM (SELECT geometry_id, gx, gy, arg_min(value, CAST(rec AS VARCHAR)) AS v FROM ins GROUP BY ALL) GROUP BY ALL")
def px06_merge_files(spark, d):
    """All records of an area on one grid, the first valid value of each place."""
    f = _archive(spark, d).area_frame(_boxes(spark), ["B1"], cell=8.0)
    return _summed(labelled.on_one_grid(f), "geometry_id")


@query(f"""WITH {_INSIDE}, met AS (SELECT geometry_id, count(DISTINCT dt) AS layers FROM recs JOIN aois ON tx < x1 AND tx + 16 > x0 AND ty - 16 < y1 AND ty > y0 GROUP BY ALL)
SELECT geometry_id, layers, count(*) AS n, sum(v) AS total FROM (SELECT geometry_id, dt, gx, gy, arg_min(value, CAST(rec AS VARCHAR)) AS v FROM ins GROUP BY ALL) JOIN met USING (geometry_id) GROUP BY ALL""")
def px13_stack_files(spark, d):
    """One layer a moment."""
    c = _archive(spark, d)
    g = labelled.on_one_grid(c.area_frame(_boxes(spark), ["B1"], cell=8.0), c.df.select(F.col("id").alias("record"), "datetime"), stack=True)
    return _summed(g.withColumn("layers", F.size("times").cast("long")), "geometry_id", "layers")


@query(f"WITH {RECS}, {PIX} SELECT CAST(rec AS VARCHAR) AS record, CAST(count(*) FILTER (value > 100) AS DOUBLE) AS area FROM recs JOIN pix USING (rec) GROUP BY ALL HAVING count(*) FILTER (value > 100) > 0")
def px17_polygons(spark, d):
    """The ground of pixels above a threshold, as polygons along their edges: its area by the rings."""
    whole = box_wkb(F.lit(-1e3), F.lit(-1e3), F.lit(1e3), F.lit(1e3))
    f = _archive(spark, d).area_frame(spark.range(1).select(F.col("id").alias("geometry_id"), whole.alias("geometry")), ["B1"], cell=1e4, mode="full").filter("error IS NULL")

    def trace(batches):
        for b in batches:
            out = []
            for q in b.to_pylist():
                v = labelled._window(q)
                for rings in labelled.polygons_of(np.nan_to_num(v, nan=-1e9) > 100, q["transform"]):
                    sizes = [abs(sum(a[0] * e[1] - e[0] * a[1] for a, e in zip(r[:-1], r[1:]))) / 2 for r in rings]
                    out.append((q["record"], sizes[0] - sum(sizes[1:])))
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.string()), pa.array([a for _, a in out], pa.float64())], names=["record", "area"])

    return f.select("record", "height", "width", "dtype", "data", "valid", "transform").mapInArrow(trace, "record string, area double").groupBy("record").agg(F.sum("area").alias("area"))


# ---- geometry, collections --------------------------------------------------------------------------------


def _record_boxes(spark, d):
    return spark.read.parquet(f"{d}/records.parquet").filter("bbox.xmin < bbox.xmax AND bbox.ymin < bbox.ymax AND abs(bbox.ymin) < 85 AND abs(bbox.ymax) < 85").select("fid", "bbox")


_M = "20037508.342789244"
_Y = lambda v: f"ln(tan(pi() / 4 + radians({v}) / 2)) * {_M} / pi()"
_BOXED = "FROM records WHERE bbox.xmin < bbox.xmax AND bbox.ymin < bbox.ymax AND abs(bbox.ymin) < 85 AND abs(bbox.ymax) < 85"


@query(f"SELECT fid, round(bbox.xmin * {_M} / 180, 3) AS xmin, round({_Y('bbox.ymin')}, 3) AS ymin, round(bbox.xmax * {_M} / 180, 3) AS xmax, round({_Y('bbox.ymax')}, 3) AS ymax {_BOXED}")
def gf08_transform_bounds(spark, d):
    @F.arrow_udf("array<double>")
    def to_mercator(b: pa.Array) -> pa.Array:
        return pa.array([crs.transform_bbox(tuple(x[k] for k in ("xmin", "ymin", "xmax", "ymax")), 4326, 3857) for x in b.to_pylist()], pa.list_(pa.float64()))

    r = _record_boxes(spark, d).select("fid", to_mercator("bbox").alias("m"))
    return r.select("fid", *[F.round(F.col("m")[i], 3).alias(k) for i, k in enumerate(("xmin", "ymin", "xmax", "ymax"))])


@query(f"SELECT fid, round(bbox.xmin * {_M} / 180, 3) AS xmin, round({_Y('bbox.ymax')}, 3) AS ymax, 'Polygon' AS kind {_BOXED}")
def gf06_transform_footprints(spark, d):
    """Footprints to another system and, as GeoJSON, out and in again."""
    b = F.col("bbox")

    @F.arrow_udf("struct<xmin: double, ymax: double, kind: string>")
    def moved(g: pa.Array) -> pa.Array:
        from scenegrain.functions import wkb

        out = []
        for x in g.to_pylist():
            j = geometry.to_geojson(geometry.transform(x, 4326, 3857))
            x0, _, _, y1 = wkb.bounds(wkb.parse(geometry.coerce(j)[0]))
            out.append({"xmin": x0, "ymax": y1, "kind": j["type"]})
        return pa.array(out, pa.struct([("xmin", pa.float64()), ("ymax", pa.float64()), ("kind", pa.string())]))

    r = _record_boxes(spark, d).select("fid", moved(box_wkb(b.xmin, b.ymin, b.xmax, b.ymax)).alias("m"))
    return r.select("fid", F.round("m.xmin", 3).alias("xmin"), F.round("m.ymax", 3).alias("ymax"), "m.kind")


@query("SELECT year(datetime) AS y, count(*) AS n, count(bbox) AS boxed FROM records WHERE datetime IS NOT NULL AND id IS NOT NULL GROUP BY ALL")
def ct06_build_from_table(spark, d):
    """A record table built into a collection on disk, and opened again by ``load``."""
    at = scratch_path(spark, "workspace")
    r = spark.read.parquet(f"{d}/records.parquet").filter("datetime IS NOT NULL AND id IS NOT NULL").withColumn("assets", F.create_map(F.lit("B04"), F.struct(F.col("assets.B04.href"), F.col("assets.B04.band_index"))).cast(ASSETS))
    catalog.build_from_table(spark, r.drop("year", "month"), "built", workspace=at)
    c = catalog.load(spark, f"{at}/built_records")
    return c.rows().groupBy(F.year("datetime").alias("y")).agg(F.count("*").alias("n"), F.count("bbox").alias("boxed"))


@query("SELECT 'earthsearch/naip' AS id, 4 AS bands UNION ALL SELECT 'aef/v1-annual', 64 UNION ALL SELECT 'earthsearch/sentinel-2-l2a', 13 UNION ALL SELECT 'pc/sentinel-2-l2a', 13")
def ct03_registry(spark, d):
    """Datasets with more than three bands of their own, from the registry as a table."""
    return catalog.Registry.frame(spark).filter("id IN ('earthsearch/naip', 'aef/v1-annual', 'earthsearch/sentinel-2-l2a', 'pc/sentinel-2-l2a')").select("id", F.size("bands").alias("bands"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
