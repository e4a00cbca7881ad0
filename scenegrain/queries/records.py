"""Scans, filters, aggregates, windows, set operations and record functions over the ``records`` table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenegrain.collection import Collection, rename_roles
from scenegrain.functions import affine, crs, predicates as P, text
from scenegrain.ingest import normalize
from scenegrain.operators.range_join import overlap_join, overlap_semi_join, points_in_boxes
from scenegrain.operators.spatial import placed_points
from scenegrain.sources import geoparquet, hub, stac

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
CC = '"eo:cloud_cover"'
BOX = (-20.0, 30.0, 40.0, 60.0)
OVER = "bbox.xmax >= -20 AND bbox.xmin <= 40 AND bbox.ymax >= 30 AND bbox.ymin <= 60"


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "records")


def _collection(spark: SparkSession, d: str) -> Collection:
    return Collection.wrap(_records(spark, d), require_band_metadata=False, name="records")


def _indexed(spark: SparkSession, d: str) -> Collection:
    r = _records(spark, d)
    wide = r.drop("year", "utm_zone")
    return Collection(wide, name="records", index=r.select("id", "source_part", "bbox", "year", "utm_zone"))


_HUB = "hf://datasets/own/archive/records.parquet"


def _mounted(d: str):
    """Addresses of the hub dataset as files of the folder."""
    return lambda address: f"{d}/{address.rsplit('/', 1)[1]}"


# ---- scans ------------------------------------------------------------------------------------------


@query("SELECT collection, count(*) AS n FROM records GROUP BY collection")
def sc01_scan(spark, d):
    return _records(spark, d).groupBy("collection").agg(F.count("*").alias("n"))


@query("SELECT collection, count(*) AS n, count(id) AS ids, min(datetime) AS first, max(datetime) AS last FROM records GROUP BY collection")
def sc02_load(spark, d):
    return Collection.from_parquet(spark, f"{d}/records.parquet").rows().groupBy("collection").agg(F.count("*").alias("n"), F.count("id").alias("ids"), F.min("datetime").alias("first"), F.max("datetime").alias("last"))


@query("SELECT CAST(fid AS VARCHAR) AS id, CAST(utc AS VARCHAR) AS zone, y AS year FROM (SELECT fid, utm_zone AS utc, year AS y, row_number() OVER (ORDER BY fid, load_id, source_part, year, utm_zone) AS k FROM records WHERE year = 2022) WHERE k <= 50")
def sc05_index_scan(spark, d):
    i = rename_roles(_records(spark, d).select("fid", "utm_zone", "year", "load_id", "source_part"), {"id": "fid", "zone": "utm_zone"})
    c = Collection(_records(spark, d), index=i)
    return c.index_rows(["id", "zone", "year"], where="year = 2022", limit=50, order=["fid", "load_id", "source_part", "year", "utm_zone"])


@query(f"SELECT id, source_part, collection FROM records r WHERE EXISTS (SELECT 1 FROM records i WHERE i.year = 2023 AND i.id = r.id AND i.source_part = r.source_part AND {OVER.replace('bbox', 'i.bbox')}) AND {OVER.replace('bbox', 'r.bbox')}")
def sc06_two_surface(spark, d):
    return _indexed(spark, d).where("year = 2023").subset(bbox=BOX).rows(["id", "source_part", "collection"])


@query("SELECT id, bbox.xmin AS xmin, bbox.ymax AS ymax, year FROM records WHERE year IS NOT NULL")
def sc07_index_as_collection(spark, d):
    c = _indexed(spark, d).index_collection().where("year IS NOT NULL")
    return c.rows().select("id", "bbox.xmin", "bbox.ymax", "year")


@query("SELECT id, crs FROM records")
def sc08_batches(spark, d):
    return _collection(spark, d).rows(["id", "crs"]).mapInArrow(lambda bs: bs, "id string, crs string")


@query("SELECT DISTINCT 'org/' || collection AS dataset, 'v' || month AS revision, 'data/' || source_part AS inside FROM records WHERE collection IS NOT NULL AND month IS NOT NULL AND source_part IS NOT NULL")
def sc09_dataset_address(spark, d):
    u = _records(spark, d).select(F.concat(F.lit("hf://datasets/org/"), "collection", F.lit("@v"), F.col("month").cast("string"), F.lit("/data/"), "source_part").alias("u")).filter("u IS NOT NULL").distinct()
    return u.select(*[F.regexp_extract("u", text.HF_URI, i).alias(n) for i, n in enumerate(("dataset", "revision", "inside"), 1)])


@query(f"SELECT id, {CC} AS cloud FROM records WHERE ({CC} < 5 AND split IN ('train', 'val')) OR (bbox.xmin >= 100 AND year = 2024)")
def sc11_pruned_scan(spark, d):
    filters = [[("eo:cloud_cover", "<", 5.0), ("split", "in", ("train", "val"))], [("bbox.xmin", ">=", 100.0), ("year", "==", 2024)]]
    return hub.read(spark, _HUB, filters=filters, mount=_mounted(d)).select("id", P.name("eo:cloud_cover").alias("cloud"))


@query("SELECT fid, id FROM records ORDER BY fid NULLS FIRST, id NULLS FIRST LIMIT 25")
def sc12_head(spark, d):
    return hub.head(spark, _HUB, 25, ["fid", "id"], columns=["fid", "id"], mount=_mounted(d))


@query("SELECT id, tile_id FROM records WHERE tile_id IS NOT NULL AND month = 6")
def sc13_projected_read(spark, d):
    return hub.read(spark, _HUB, filters=[[("month", "==", 6)]], columns=["id", "tile_id"], mount=_mounted(d)).filter("tile_id IS NOT NULL")


_ITEMS = "SELECT DISTINCT id, collection, datetime, bbox, cc FROM (SELECT id, collection, date_trunc('second', datetime) AS datetime, bbox, CASE WHEN isnan(\"eo:cloud_cover\") THEN NULL ELSE \"eo:cloud_cover\" END AS cc FROM records WHERE id IS NOT NULL AND datetime IS NOT NULL AND bbox IS NOT NULL)"


def _stac_json(spark, d):
    r = _records(spark, d).filter("id IS NOT NULL AND datetime IS NOT NULL AND bbox IS NOT NULL")
    cc = F.when(~F.isnan(P.name("eo:cloud_cover")), P.name("eo:cloud_cover"))
    props = F.struct(F.date_format("datetime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"), cc.alias("eo:cloud_cover"))
    return r.select(F.to_json(F.struct("id", "collection", F.array(*[F.col(f"bbox.{c}") for c in ("xmin", "ymin", "xmax", "ymax")]).alias("bbox"), props.alias("properties"))).alias("item")).distinct()


@query(f"SELECT id, collection, datetime, cc AS cloud FROM ({_ITEMS}) WHERE bbox.xmax >= -20 AND bbox.xmin <= 40 AND bbox.ymax >= 30 AND bbox.ymin <= 60 AND datetime BETWEEN TIMESTAMP '2020-01-01' AND TIMESTAMP '2021-12-31 23:59:59'")
def sc14_stac_search(spark, d):
    return stac.search(stac.items(_stac_json(spark, d), "item"), bbox=BOX, date_range=("2020-01-01", "2021-12-31")).select("id", "collection", "datetime", P.name("eo:cloud_cover").alias("cloud"))


@query("""SELECT fid, CASE WHEN k IN (0, 1) THEN 's3' WHEN k = 2 THEN 'gcs' WHEN k = 3 THEN 'azure' WHEN k = 4 THEN 'http' ELSE 'local' END AS store,
 CASE WHEN k IN (0, 1) THEN 'quilt-archive' WHEN k = 2 THEN 'bkt' WHEN k = 3 THEN 'acct' WHEN k = 4 THEN 'quilt-archive.s3.us-west-2.amazonaws.com' ELSE '' END AS bucket
 FROM (SELECT DISTINCT fid, fid % 6 AS k FROM records)""")
def sc18_route(spark, d):
    k = F.col("fid") % 6
    path = F.concat(F.lit("a/"), F.col("fid").cast("string"), F.lit(".tif"))
    url = (
        F.when(k == 0, F.concat(F.lit("s3://quilt-archive/"), path)).when(k == 1, F.concat(F.lit("https://quilt-archive.s3.us-west-2.amazonaws.com/"), path))
        .when(k == 2, F.concat(F.lit("https://storage.googleapis.com/bkt/"), path)).when(k == 3, F.concat(F.lit("https://acct.blob.core.windows.net/box/"), path))
        .when(k == 4, F.concat(F.lit("https://quilt-archive.s3.us-west-2.amazonaws.com/"), path, F.lit("?X-Amz-Signature=x"))).otherwise(F.concat(F.lit("/data/"), path))
    )
    store, bucket = text.route_columns(F.col("url"))
    return _records(spark, d).select("fid").distinct().select("fid", url.alias("url")).select("fid", store.alias("store"), bucket.alias("bucket"))


# ---- sinks ------------------------------------------------------------------------------------------


@query("SELECT year, month, count(*) AS n, count(DISTINCT id) AS ids FROM records GROUP BY ALL")
def sk01_export_round_trip(spark, d):
    from scenegrain.session import scratch_path

    path = scratch_path(spark, "export")
    _collection(spark, d).export(path)
    return spark.read.parquet(path).groupBy("year", "month").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query("SELECT id, split FROM records WHERE split = 'test'")
def sk03_materialise(spark, d):
    return _collection(spark, d).select_split("test").rows(["id", "split"])


@query("""SELECT DISTINCT CASE get_bit(b, 0) WHEN 1 THEN 'Polygon' END AS geometry_type FROM (SELECT '1'::BIT AS b) WHERE FALSE
UNION SELECT DISTINCT CASE substr(h, CASE WHEN substr(h, 1, 2) = '01' THEN 3 ELSE 9 END, 2) WHEN '01' THEN 'Point' WHEN '03' THEN 'Polygon' WHEN '06' THEN 'MultiPolygon' WHEN '07' THEN 'GeometryCollection' END FROM (SELECT hex(geometry) AS h FROM records WHERE octet_length(geometry) >= 5)
WHERE substr(h, CASE WHEN substr(h, 1, 2) = '01' THEN 3 ELSE 9 END, 2) IN ('01', '03', '06', '07')""")
def sk05_geometry_types(spark, d):
    return geoparquet.geometry_types(_records(spark, d))


@query("SELECT count(*) AS records, min(datetime) AS first, max(datetime) AS last, min(bbox.xmin) AS xmin, min(bbox.ymin) AS ymin, max(bbox.xmax) AS xmax, max(bbox.ymax) AS ymax, count(DISTINCT \"proj:epsg\") AS crs_count FROM records")
def sk06_describe(spark, d):
    return _collection(spark, d).describe()


# ---- filters ----------------------------------------------------------------------------------------


@query(f"SELECT id, {CC} AS cloud FROM records WHERE {CC} < 20")
def fl01_cloud(spark, d):
    return _collection(spark, d).subset(cloud_cover_lt=20).rows(["id", "eo:cloud_cover"]).withColumnRenamed("eo:cloud_cover", "cloud")


@query("SELECT id, datetime FROM records WHERE datetime BETWEEN TIMESTAMP '2021-03-01' AND TIMESTAMP '2021-09-30'")
def fl02_dates(spark, d):
    c = _collection(spark, d)
    # year and month of this table are as delivered, not derived from datetime: they must not narrow the range
    return Collection(c.df.drop("year", "month")).subset(date_range=("2021-03-01", "2021-09-30")).rows(["id", "datetime"])


@query("SELECT id, year FROM records WHERE year BETWEEN 2019 AND 2020")
def fl03_years(spark, d):
    return _records(spark, d).filter(P.date_between("2019-06-01", "2020-02-01", "year", "int")).select("id", "year")


@query(f"SELECT id FROM records WHERE {OVER}")
def fl04_bbox(spark, d):
    return _collection(spark, d).subset(bbox=BOX).rows(["id"])


@query("SELECT id FROM records WHERE (bbox.xmax >= 0 AND bbox.xmin <= 10 AND bbox.ymax >= 40 AND bbox.ymin <= 50) OR (bbox.xmax >= 100 AND bbox.xmin <= 120 AND bbox.ymax >= -40 AND bbox.ymin <= -10)")
def fl05_geometries(spark, d):
    return _collection(spark, d).subset(geometries=[(0, 40, 10, 50), (100, -40, 120, -10)]).rows(["id"])


@query("SELECT id, split FROM records WHERE split IN ('val', 'test')")
def fl06_splits(spark, d):
    return _collection(spark, d).select_split(["val", "test"]).rows(["id", "split"])


@query(f"SELECT id, datetime FROM records WHERE {CC} < 40 AND datetime BETWEEN TIMESTAMP '2020-01-01' AND TIMESTAMP '2024-12-31' AND {OVER} AND split = 'train'")
def fl07_subset(spark, d):
    c = Collection(_records(spark, d).drop("year", "month"))
    return c.subset(cloud_cover_lt=40, date_range=("2020-01-01", "2024-12-31"), bbox=BOX, split="train").rows(["id", "datetime"])


@query(f"SELECT id, source_part FROM records r WHERE {OVER.replace('bbox', 'r.bbox')} AND {CC} < 30 AND EXISTS (SELECT 1 FROM records i WHERE i.id = r.id AND i.source_part = r.source_part AND {OVER.replace('bbox', 'i.bbox')})")
def fl08_two_surface_subset(spark, d):
    return _indexed(spark, d).subset(bbox=BOX, cloud_cover_lt=30).rows(["id", "source_part"])


@query("SELECT id, label FROM records WHERE label >= 3 AND collection LIKE 'orbis%'")
def fl09_where(spark, d):
    return _collection(spark, d).where("label >= 3 AND collection LIKE 'orbis%'").rows(["id", "label"])


@query(f"SELECT id FROM records WHERE (split = 'train' OR label > 2) AND ({CC} <= 10 OR month = 1)")
def fl10_dnf(spark, d):
    both = P.dnf_and([[("split", "==", "train")], [("label", ">", 2)]], [[("eo:cloud_cover", "<=", 10.0)], [("month", "==", 1)]])
    return _records(spark, d).filter(P.dnf(both)).select("id")


@query("SELECT id, year FROM records WHERE bbox.xmax >= -20 AND bbox.xmin <= 40 AND bbox.ymax >= 30 AND bbox.ymin <= 60 AND datetime >= TIMESTAMP '2022-01-01'")
def fl11_build_pushdown(spark, d):
    return _records(spark, d).filter(P.bbox_overlaps(BOX) & P.date_between("2022-01-01", None)).select("id", "year")


@query("SELECT r.id FROM records r, (SELECT greatest(min(point_x), -60.0) AS x0, least(max(point_x), 60.0) AS x1, greatest(min(point_y), 0.0) AS y0, least(max(point_y), 80.0) AS y1 FROM points WHERE point_crs = 4326 AND abs(point_x) <= 180 AND abs(point_y) <= 90) q WHERE bbox.xmax >= x0 AND bbox.xmin <= x1 AND bbox.ymax >= y0 AND bbox.ymin <= y1")
def fl12_derived_bbox(spark, d):
    from scenegrain.plans.two_surface import narrow

    p = _t(spark, d, "points").filter("point_crs = 4326 AND abs(point_x) <= 180 AND abs(point_y) <= 90")
    x, y = F.col("point_x"), F.col("point_y")
    boxes = p.select(F.struct(x.alias("xmin"), y.alias("ymin"), x.alias("xmax"), y.alias("ymax")).alias("bbox"))
    return narrow(_records(spark, d), boxes, (-60.0, 0.0, 60.0, 80.0)).select("id")


@query("SELECT id, datetime, collection FROM records WHERE id IS NOT NULL ORDER BY datetime NULLS FIRST, id, collection NULLS FIRST LIMIT 30")
def fl13_head(spark, d):
    return _collection(spark, d).where("id IS NOT NULL").head(30, ["id", "datetime", "collection"], order=["datetime", "id", "collection"])


@query("SELECT id, tile_id, tile_id AS scene FROM records")
def fl14_alias(spark, d):
    return normalize.alias_columns(_records(spark, d), {"tile_id": "scene", "fid": "id"}).select("id", "tile_id", "scene")


@query(f"SELECT id FROM records WHERE bbox.xmax >= 0 AND bbox.xmin <= 10 AND bbox.ymax >= 40 AND bbox.ymin <= 50 AND {CC} < 50")
def fl15_chip_prefilter(spark, d):
    return _collection(spark, d).subset(cloud_cover_lt=50).subset(bbox=(0, 40, 10, 50)).rows(["id"])


# ---- joins ------------------------------------------------------------------------------------------


@query("SELECT id, collection FROM records r WHERE EXISTS (SELECT 1 FROM records i WHERE i.utm_zone = '31N' AND i.id = r.id AND i.source_part = r.source_part)")
def jn01_semi(spark, d):
    return _indexed(spark, d).where("utm_zone = '31N'").rows(["id", "collection"])


_PTS = "SELECT DISTINCT point_index, point_x AS lon, point_y AS lat FROM points WHERE geometry IS NULL AND coalesce(point_crs, 4326) = 4326 AND abs(point_x) <= 180 AND abs(point_y) <= 90 AND NOT isnan(point_x) AND NOT isnan(point_y)"


def _lonlat(spark, d):
    p = _t(spark, d, "points").filter("geometry IS NULL AND coalesce(point_crs, 4326) = 4326")
    return placed_points(p)


@query(f"SELECT DISTINCT point_index, fid FROM ({_PTS}) p JOIN records r ON lon BETWEEN r.bbox.xmin AND r.bbox.xmax AND lat BETWEEN r.bbox.ymin AND r.bbox.ymax")
def jn02_points_in_boxes(spark, d):
    r = _records(spark, d).select("fid", "bbox").distinct()
    return points_in_boxes(_lonlat(spark, d), r, "lon", "lat", "bbox").select("point_index", "fid").distinct()


_AOIS = "SELECT a.i AS aoi, -180.0 + 40 * i AS x0, -150.0 + 40 * i AS x1, -20.0 AS y0, 20.0 AS y1 FROM range(9) a(i)"


def _aois(spark):
    i = F.col("id")
    lo = i * 40 - 180.0
    return spark.range(9).select(i.alias("aoi"), F.struct(lo.alias("xmin"), F.lit(-20.0).alias("ymin"), (lo + 30).alias("xmax"), F.lit(20.0).alias("ymax")).alias("aoi_bbox"))


@query(f"SELECT aoi, id FROM records, ({_AOIS}) WHERE bbox.xmax >= x0 AND bbox.xmin <= x1 AND bbox.ymax >= y0 AND bbox.ymin <= y1 AND bbox.xmin <= bbox.xmax AND bbox.ymin <= bbox.ymax")
def jn03_aois(spark, d):
    return overlap_join(_records(spark, d).select("id", "bbox"), _aois(spark), "bbox", "aoi_bbox", 2.0).select("aoi", "id")


@query("SELECT point_index, sensor_id, plot_id, tag FROM points LEFT JOIN (SELECT plot_id, 'p' || count(*) AS tag FROM points WHERE plot_id IS NOT NULL GROUP BY plot_id HAVING count(*) > 2) USING (plot_id)")
def jn04_left_metadata(spark, d):
    p = _t(spark, d, "points")
    meta = p.filter("plot_id IS NOT NULL").groupBy("plot_id").count().filter("count > 2").select("plot_id", F.concat(F.lit("p"), F.col("count").cast("string")).alias("tag"))
    return p.join(meta, "plot_id", "left").select("point_index", "sensor_id", "plot_id", "tag")


@query("SELECT v.vec_id, p.sensor_id FROM patch_vectors v JOIN (SELECT point_index, max(sensor_id) AS sensor_id FROM points GROUP BY 1) p ON v.geometry_id = p.point_index")
def jn05_point_metadata(spark, d):
    meta = _t(spark, d, "points").groupBy("point_index").agg(F.max("sensor_id").alias("sensor_id"))
    return _t(spark, d, "patch_vectors").join(meta, F.col("geometry_id") == F.col("point_index")).select("vec_id", "sensor_id")


@query("SELECT fid, 'B04' AS band, assets.B04.href AS href FROM records WHERE assets.B04.href IS NOT NULL UNION ALL SELECT fid, 'B08', assets.B08.href FROM records WHERE assets.B08.href IS NOT NULL")
def jn07_band_resolution(spark, d):
    from scenegrain.ingest.enrich import resolve_bands

    r = normalize.assets_map(_records(spark, d)).select("fid", "assets")
    return resolve_bands(r, ["red", "nir"], {"B04": "red", "B08": "nir"}).select("fid", F.when(F.col("band") == "red", "B04").otherwise("B08").alias("band"), "href")


@query("SELECT fid, href, length(href) AS width FROM (SELECT fid, min(assets.B04.href) AS href FROM records WHERE fid IS NOT NULL GROUP BY fid)")
def jn08_headers_back(spark, d):
    """Headers, one a file, joined back to every record that names it."""
    from scenegrain.ingest.enrich import url_index, with_headers

    r = _records(spark, d).filter("fid IS NOT NULL").groupBy("fid").agg(F.min("assets.B04.href").alias("href"))
    r = r.withColumn("assets", F.create_map(F.lit("B04"), F.struct("href", F.lit(0).alias("band_index"))).cast(normalize.ASSETS))
    heads = url_index(r, "fid", ["B04"]).select("href").distinct().withColumn("header", F.struct(F.length("href").alias("image_width")))
    return with_headers(r, heads, ["B04"], "fid").select("fid", "href", F.col("B04_metadata.image_width").alias("width"))


@query(f"SELECT aoi, count(*) AS n, count(DISTINCT id) AS ids FROM records, ({_AOIS}) WHERE bbox.xmax >= x0 AND bbox.xmin <= x1 AND bbox.ymax >= y0 AND bbox.ymin <= y1 AND bbox.xmin <= bbox.xmax AND bbox.ymin <= bbox.ymax GROUP BY aoi")
def jn09_spatial_join(spark, d):
    return overlap_join(_records(spark, d).select("id", "bbox"), _aois(spark), "bbox", "aoi_bbox", 2.0).groupBy("aoi").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


def _triangle_aois(spark):
    """The lower left half of each AOI's box, as a footprint."""
    from scenegrain.functions import wkb

    rows = [(r.aoi, wkb.polygon([(r.x0, r.y0), (r.x1, r.y0), (r.x0, r.y1), (r.x0, r.y0)])) for r in _aois(spark).select("aoi", "aoi_bbox.*").toDF("aoi", "x0", "y0", "x1", "y1").collect()]  # nine
    return _aois(spark).join(spark.createDataFrame(rows, "aoi long, shape binary"), "aoi")


@query(f"""WITH m AS (SELECT fid, aoi, (greatest(bbox.xmin, x0) - x0) / (x1 - x0) + (greatest(bbox.ymin, y0) - y0) / (y1 - y0) AS near FROM records, ({_AOIS})
 WHERE bbox.xmin < bbox.xmax AND bbox.ymin < bbox.ymax AND bbox.xmax >= x0 AND bbox.xmin <= x1 AND bbox.ymax >= y0 AND bbox.ymin <= y1) SELECT DISTINCT fid, aoi FROM m WHERE near <= 1""")
def jn09_footprints(spark, d):
    """Footprints (drawn from the boxes) that share ground with a triangle."""
    from scenegrain.operators.range_join import footprint_join

    r = _with_box_wkb(_records(spark, d).select("fid", "bbox"))
    return footprint_join(r, _triangle_aois(spark), "geometry", "shape", "bbox", "aoi_bbox", 2.0).select("fid", "aoi").distinct()


@query(f"""WITH m AS (SELECT fid, aoi, (bbox.xmax - x0) / (x1 - x0) + (bbox.ymax - y0) / (y1 - y0) AS far FROM records, ({_AOIS})
 WHERE bbox.xmin < bbox.xmax AND bbox.ymin < bbox.ymax AND bbox.xmin >= x0 AND bbox.ymin >= y0) SELECT DISTINCT fid, aoi FROM m WHERE far <= 1""")
def jn12_footprints(spark, d):
    """Footprints that lie wholly in a triangle."""
    from scenegrain.operators.range_join import footprint_join

    r = _with_box_wkb(_records(spark, d).select("fid", "bbox"))
    return footprint_join(_triangle_aois(spark), r, "shape", "geometry", "aoi_bbox", "bbox", 2.0, how="covers").select("fid", "aoi").distinct()


@query(f"SELECT fid, bbox IS NOT NULL AND coalesce(bool_or(bbox.xmax >= x0 AND bbox.xmin <= x1 AND bbox.ymax >= y0 AND bbox.ymin <= y1 AND bbox.xmin <= bbox.xmax AND bbox.ymin <= bbox.ymax), FALSE) AS inside FROM (SELECT DISTINCT fid, bbox FROM records), ({_AOIS}) GROUP BY fid, bbox")
def jn10_flag(spark, d):
    r = _records(spark, d).select("fid", "bbox").distinct()
    hit = overlap_semi_join(r, _aois(spark).select(F.col("aoi_bbox").alias("bbox"))).select("bbox").distinct().select(F.col("bbox").alias("b_"), F.lit(True).alias("hit"))
    return r.join(hit, r["bbox"] == hit["b_"], "left").select("fid", F.coalesce("hit", F.lit(False)).alias("inside"))


@query("SELECT v.vec_id, r.split FROM patch_vectors v LEFT JOIN (SELECT id, max(split) AS split FROM records WHERE id IS NOT NULL GROUP BY 1) r ON v.record_id = r.id")
def jn11_labels_back(spark, d):
    labels = _records(spark, d).filter("id IS NOT NULL").groupBy("id").agg(F.max("split").alias("split"))
    return _t(spark, d, "patch_vectors").join(labels, F.col("record_id") == F.col("id"), "left").select("vec_id", "split")


@query(f"SELECT DISTINCT v.vec_id, r.fid FROM patch_vectors v JOIN records r ON v.record_id = r.id JOIN ({_PTS}) p ON p.point_index = v.geometry_id WHERE p.lon - 0.01 >= r.bbox.xmin AND p.lon + 0.01 <= r.bbox.xmax AND p.lat - 0.01 >= r.bbox.ymin AND p.lat + 0.01 <= r.bbox.ymax")
def jn12_patch_in_scene(spark, d):
    v = _t(spark, d, "patch_vectors").select("vec_id", "record_id", "geometry_id")
    j = v.join(_records(spark, d).select(F.col("id").alias("record_id"), "fid", "bbox"), "record_id").join(_lonlat(spark, d).withColumnRenamed("point_index", "geometry_id"), "geometry_id")
    b = F.col("bbox")
    ok = (F.col("lon") - 0.01 >= b.xmin) & (F.col("lon") + 0.01 <= b.xmax) & (F.col("lat") - 0.01 >= b.ymin) & (F.col("lat") + 0.01 <= b.ymax)
    return j.filter(ok).select("vec_id", "fid").distinct()


_LATEST = f"""SELECT point_index, fid FROM (SELECT point_index, fid, row_number() OVER (PARTITION BY point_index ORDER BY datetime DESC NULLS LAST, fid) AS k FROM ({_PTS}) p JOIN (SELECT fid, max(datetime) AS datetime, bbox FROM records GROUP BY fid, bbox) r
ON lon BETWEEN r.bbox.xmin AND r.bbox.xmax AND lat BETWEEN r.bbox.ymin AND r.bbox.ymax) WHERE k = 1"""


@query(_LATEST)
def jn13_latest(spark, d):
    r = _records(spark, d).groupBy("fid", "bbox").agg(F.max("datetime").alias("datetime"))
    j = points_in_boxes(_lonlat(spark, d), r, "lon", "lat", "bbox")
    w = Window.partitionBy("point_index").orderBy(F.desc_nulls_last("datetime"), "fid")
    return j.withColumn("k", F.row_number().over(w)).filter("k = 1").select("point_index", "fid")


@query("SELECT fid FROM records WHERE datetime > TIMESTAMP '2020-01-01' AND datetime <= TIMESTAMP '2020-07-01'")
def jn14_time_slice(spark, d):
    from scenegrain.operators.chips import in_slice

    return _records(spark, d).filter(in_slice(F.col("datetime"), "2020-01-01", "2020-07-01")).select("fid")


@query("""SELECT count(*) AS pairs FROM (SELECT DISTINCT fid, bbox FROM records WHERE split = 'val' AND bbox.xmin < bbox.xmax) a JOIN (SELECT DISTINCT fid, bbox FROM records WHERE split = 'test' AND bbox.xmin < bbox.xmax) b
ON least(a.bbox.xmax, b.bbox.xmax) > greatest(a.bbox.xmin, b.bbox.xmin) AND least(a.bbox.ymax, b.bbox.ymax) > greatest(a.bbox.ymin, b.bbox.ymin)""")
def jn15_intersection(spark, d):
    r = _records(spark, d).filter("bbox.xmin < bbox.xmax")
    a, b = (r.filter(F.col("split") == s).select("fid", "bbox").distinct().select(F.col("fid").alias(f"fid_{s}"), F.col("bbox").alias(f"bbox_{s}")) for s in ("val", "test"))
    return overlap_join(a, b, "bbox_val", "bbox_test", 0.5, touching=False).agg(F.count("*").alias("pairs"))


# ---- aggregates ---------------------------------------------------------------------------------------


@query("SELECT count(*) AS n FROM records WHERE year = 2023")
def ag01_count(spark, d):
    return _collection(spark, d).where("year = 2023").rows().agg(F.count("*").alias("n"))


@query("SELECT min(bbox.xmin) AS xmin, min(bbox.ymin) AS ymin, max(bbox.xmax) AS xmax, max(bbox.ymax) AS ymax FROM records")
def ag02_bounds(spark, d):
    return _collection(spark, d).bounds()


@query('SELECT DISTINCT "proj:epsg" AS epsg FROM records WHERE "proj:epsg" IS NOT NULL')
def ag03_epsg(spark, d):
    return _collection(spark, d).epsg()


@query('SELECT epsg FROM (SELECT "proj:epsg" AS epsg, count(*) AS n FROM records WHERE "proj:epsg" IS NOT NULL GROUP BY 1) ORDER BY n DESC, epsg LIMIT 1')
def ag04_modal_crs(spark, d):
    return _collection(spark, d).modal_epsg()


@query("SELECT min(datetime) AS first, max(datetime) AS last FROM records")
def ag05_dates(spark, d):
    return _records(spark, d).agg(F.min("datetime").alias("first"), F.max("datetime").alias("last"))


@query("SELECT href, count(*) AS uses, min(band) AS band FROM (SELECT assets.B04.href AS href, 'B04' AS band FROM records UNION ALL SELECT assets.B08.href, 'B08' FROM records) WHERE href IS NOT NULL GROUP BY href")
def ag09_dedupe_urls(spark, d):
    from scenegrain.ingest.enrich import url_index

    u = url_index(normalize.assets_map(_records(spark, d)), "fid")
    return u.groupBy("href").agg(F.count("*").alias("uses"), F.min("band").alias("band"))


@query(f"SELECT collection, count(*) AS n, min(datetime) AS first, max(datetime) AS last, round(avg({CC}) FILTER ({CC} BETWEEN 0 AND 100), 6) AS cloud FROM records GROUP BY collection ORDER BY n DESC")
def ag10_summary(spark, d):
    cc = P.name("eo:cloud_cover")
    return _records(spark, d).groupBy("collection").agg(F.count("*").alias("n"), F.min("datetime").alias("first"), F.max("datetime").alias("last"), F.round(F.avg(F.when(cc.between(0, 100), cc)), 6).alias("cloud")).orderBy(F.desc("n"))


@query("SELECT b AS missing FROM (SELECT unnest(['B02', 'B04', 'B08', 'B11']) AS b) WHERE b NOT IN ('B04', 'B08')")
def ag18_band_coverage(spark, d):
    have = F.array_distinct(F.flatten(F.collect_set(F.map_keys("assets"))))
    a = normalize.assets_map(_records(spark, d)).agg(have.alias("have"))
    return a.select(F.explode(F.array_except(F.array(*map(F.lit, ("B02", "B04", "B08", "B11"))), "have")).alias("missing"))


# ---- windows ------------------------------------------------------------------------------------------


@query("SELECT fid FROM (SELECT fid, row_number() OVER (ORDER BY datetime, fid) - 1 AS k FROM (SELECT DISTINCT fid, datetime FROM records WHERE datetime > TIMESTAMP '2023-01-01' AND datetime <= TIMESTAMP '2023-02-01')) WHERE k % 5 = 0")
def wn07_stride(spark, d):
    from scenegrain.operators.chips import in_slice, stride

    r = _records(spark, d).filter(in_slice(F.col("datetime"), "2023-01-01", "2023-02-01")).select("fid", "datetime").distinct()
    return stride(r, ["datetime", "fid"], 5).select("fid")


@query("SELECT fid, id FROM records ORDER BY fid NULLS FIRST, id NULLS FIRST LIMIT 1")
def wn09_first(spark, d):
    return _collection(spark, d).head(1, ["fid", "id"], order=["fid", "id"])


@query("SELECT id, source_part, fid FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY source_part, fid) AS k FROM (SELECT DISTINCT id, source_part, fid FROM records WHERE id IS NOT NULL AND source_part IS NOT NULL)) WHERE k = 1 ORDER BY id LIMIT 500")
def wn10_shard_dedupe(spark, d):
    r = _records(spark, d).filter("id IS NOT NULL AND source_part IS NOT NULL")
    first = r.groupBy("id").agg(F.min(F.struct("source_part", "fid")).alias("f"))
    return first.select("id", "f.source_part", "f.fid").orderBy("id").limit(500)


@query("SELECT fid, crs FROM (SELECT fid, crs, row_number() OVER (PARTITION BY crs ORDER BY fid) AS k FROM (SELECT fid, min(crs) AS crs FROM records WHERE crs IS NOT NULL GROUP BY fid)) ORDER BY CASE WHEN k > 1 THEN 1 ELSE 0 END, fid LIMIT 200")
def wn11_stratified(spark, d):
    r = _records(spark, d).filter("crs IS NOT NULL").groupBy("fid").agg(F.min("crs").alias("crs"))
    first = r.groupBy("crs").agg(F.min("fid").alias("fid")).select("fid", F.lit(0).alias("o"))
    j = r.join(first, "fid", "left").orderBy(F.coalesce("o", F.lit(1)), "fid").limit(200)
    return j.select("fid", "crs")


# ---- sets ---------------------------------------------------------------------------------------------


@query("SELECT id, split FROM records WHERE split = 'val' UNION ALL SELECT id, split FROM records WHERE split = 'test'")
def st01_union(spark, d):
    r = _records(spark, d).select("id", "split")
    return r.filter("split = 'val'").unionByName(r.filter("split = 'test'"))


@query("SELECT fid AS key, id, NULL AS sensor_id FROM records WHERE month = 2 UNION ALL SELECT point_index, NULL, sensor_id FROM points")
def st02_permissive_union(spark, d):
    a = _records(spark, d).filter("month = 2").select(F.col("fid").alias("key"), "id")
    return a.unionByName(_t(spark, d, "points").select(F.col("point_index").alias("key"), "sensor_id"), allowMissingColumns=True)


@query("SELECT fid, greatest(bbox.xmin, -20.0) AS xmin, greatest(bbox.ymin, 30.0) AS ymin, least(bbox.xmax, 40.0) AS xmax, least(bbox.ymax, 60.0) AS ymax FROM records WHERE bbox.xmin <= 40 AND bbox.xmax >= -20 AND bbox.ymin <= 60 AND bbox.ymax >= 30")
def st03_box_intersection(spark, d):
    b = F.col("bbox")
    x = _records(spark, d).filter(P.bbox_overlaps(BOX))
    return x.select("fid", F.greatest(b.xmin, F.lit(BOX[0])).alias("xmin"), F.greatest(b.ymin, F.lit(BOX[1])).alias("ymin"), F.least(b.xmax, F.lit(BOX[2])).alias("xmax"), F.least(b.ymax, F.lit(BOX[3])).alias("ymax"))


@query("SELECT tile_id FROM records WHERE split = 'train' INTERSECT SELECT tile_id FROM records WHERE split = 'test'")
def st04_intersect(spark, d):
    r = _records(spark, d)
    return r.filter("split = 'train'").select("tile_id").intersect(r.filter("split = 'test'").select("tile_id"))


# ---- record functions -----------------------------------------------------------------------------------


@query("SELECT CAST(fid AS VARCHAR) AS id, make_timestamp(year, 1, 1, 0, 0, 0) AS datetime FROM records")
def nm01_id_and_year(spark, d):
    r = _records(spark, d).select(F.col("fid").alias("id"), F.col("year").alias("datetime"))
    return normalize.prepare_records(r)


@query("SELECT fid, CASE WHEN assets.B04.href IS NULL THEN 0 ELSE 2 END AS bands, assets.B04.href AS href FROM records")
def nm02_assets(spark, d):
    r = _records(spark, d).select("fid", F.col("assets.B04.href").alias("path"))
    a = normalize.assets_from_href(r, "path", {"A00": 0, "A01": 1})
    return a.select("fid", F.size("assets").alias("bands"), F.col("assets")["A01"]["href"].alias("href"))


@query("SELECT fid, replace(assets.B04.href, 's3://quilt-archive/', 'https://mirror.example/q/') AS url FROM records")
def nm03_rewrite(spark, d):
    return _records(spark, d).select("fid", text.rewrite_prefix_column(F.col("assets.B04.href"), {"s3://quilt-archive/": "https://mirror.example/q/"}).alias("url"))


@query("""SELECT fid, coalesce("proj:epsg", e) AS epsg, coalesce('EPSG:' || coalesce("proj:epsg", e), nullif(crs, '')) AS code
FROM (SELECT fid, crs, "proj:epsg", CASE WHEN regexp_full_match(trim(crs), '([Ee][Pp][Ss][Gg]:)?[0-9]+') THEN TRY_CAST(regexp_extract(trim(crs), '([0-9]+)$', 1) AS INT) END AS e FROM records)""")
def nm04_crs_sidecars(spark, d):
    return normalize.crs_sidecars(_records(spark, d).select("fid", "crs", P.name("proj:epsg"))).select("fid", P.name("proj:epsg").alias("epsg"), F.col("crs").alias("code"))


@query("SELECT id, CAST(year(datetime) AS INT) AS year, CAST(month(datetime) AS INT) AS month FROM records")
def nm06_partitions(spark, d):
    return normalize.with_partitions(_records(spark, d).select("id", "datetime")).select("id", "year", "month")


@query("SELECT fid, bbox.xmin AS xmin, bbox.ymin AS ymin, bbox.xmax AS xmax, bbox.ymax AS ymax FROM records WHERE bbox IS NOT NULL")
def nm07_list_box(spark, d):
    b = F.col("bbox")
    r = _records(spark, d).filter("bbox IS NOT NULL").select("fid", F.array(b.xmin, b.ymin, b.xmax, b.ymax).alias("bbox"))
    return normalize.box_struct(r).select("fid", "bbox.*")


@query("""SELECT fid, id, datetime, CASE WHEN assets IS NULL THEN NULL ELSE (CASE WHEN assets.B04 IS NULL THEN 0 ELSE 1 END) + (CASE WHEN assets.B08 IS NULL THEN 0 ELSE 1 END) END AS bands, CAST(year(datetime) AS INT) AS year
FROM records""")
def nm08_normalise(spark, d):
    r = _records(spark, d).drop("year", "month")
    n = normalize.normalise(r)
    return n.select("fid", "id", "datetime", F.when(F.size("assets") >= 0, F.size("assets")).alias("bands"), "year")


@query(f"SELECT id, collection, datetime, bbox.xmin AS xmin, cc AS cloud FROM ({_ITEMS})")
def nm09_stac_items(spark, d):
    return stac.items(_stac_json(spark, d), "item").select("id", "collection", "datetime", "bbox.xmin", P.name("eo:cloud_cover").alias("cloud"))


@query('SELECT tile_id, CASE WHEN min("proj:epsg") = max("proj:epsg") THEN min("proj:epsg") END AS epsg, count(DISTINCT "proj:epsg") > 1 AS conflict FROM records WHERE tile_id IS NOT NULL GROUP BY tile_id')
def nm10_one_crs(spark, d):
    from scenegrain.ingest.enrich import one_crs

    return one_crs(_records(spark, d).filter("tile_id IS NOT NULL"), "tile_id", "proj:epsg")


@query("SELECT fid, coalesce(assets.B08.href, assets.B04.href) AS href FROM records")
def nm12_preferred_asset(spark, d):
    from scenegrain.ingest.enrich import preferred_href

    a = normalize.assets_map(_records(spark, d))
    return a.select("fid", preferred_href(F.col("assets"), ["s3_red", "B08", "B04"]).alias("href"))


@query("SELECT fid, 'B04' AS band, assets.B04.href AS href, coalesce(assets.B04.band_index, 0) AS band_index FROM records WHERE assets.B04.href IS NOT NULL UNION ALL SELECT fid, 'B08', assets.B08.href, coalesce(assets.B08.band_index, 0) FROM records WHERE assets.B08.href IS NOT NULL")
def nm14_url_index(spark, d):
    from scenegrain.ingest.enrich import url_index

    return url_index(normalize.assets_map(_records(spark, d)), "fid").select(F.col("record").alias("fid"), "band", "href", "band_index")


@query("""SELECT DISTINCT regexp_replace(lower(tile_id), '[^a-z0-9]+', '-', 'g') || '_' || strftime(datetime, '%Y%m') || '-' || CASE WHEN year(datetime) = year(datetime + INTERVAL 90 DAY) THEN strftime(datetime + INTERVAL 90 DAY, '%m') ELSE strftime(datetime + INTERVAL 90 DAY, '%Y%m') END || '_' || collection AS name
FROM records WHERE tile_id IS NOT NULL AND datetime >= TIMESTAMP '1990-01-01' AND datetime < TIMESTAMP '2030-01-01' AND collection IS NOT NULL""")
def nm18_names(spark, d):
    r = _records(spark, d).filter("tile_id IS NOT NULL AND datetime >= TIMESTAMP_NTZ '1990-01-01' AND datetime < TIMESTAMP_NTZ '2030-01-01' AND collection IS NOT NULL")
    return r.select(text.name_column(F.col("tile_id"), F.col("datetime"), F.expr("datetime + INTERVAL 90 DAYS"), F.col("collection")).alias("name")).distinct()


@query("SELECT min(collection) AS data_source FROM records WHERE collection <> ''")
def nm19_data_source(spark, d):
    return spark.createDataFrame([(normalize.infer_data_source(_records(spark, d)),)], "data_source string")


@query("SELECT fid, TRY_CAST(trim(CASE fid % 5 WHEN 0 THEN 'nan' WHEN 1 THEN ' -128 ' WHEN 2 THEN '' WHEN 3 THEN 'x' ELSE '1e3' END) AS DOUBLE) AS nodata FROM records")
def nm20_nodata(spark, d):
    k = F.col("fid") % 5
    t = F.when(k == 0, "nan").when(k == 1, " -128 ").when(k == 2, "").when(k == 3, "x").otherwise("1e3")
    return _records(spark, d).select("fid", text.nodata_column(t).alias("nodata"))


@query('SELECT fid, "proj:epsg" AS epsg FROM records WHERE "proj:epsg" IS NOT NULL')
def nm21_epsg_of_wkt(spark, d):
    wkt = F.concat(F.lit('PROJCRS["x",BASEGEOGCRS["y",ID["EPSG",4326]],ID["EPSG",'), P.name("proj:epsg").cast("string"), F.lit("]]"))
    return _records(spark, d).filter("`proj:epsg` IS NOT NULL").select("fid", crs.epsg_column(wkt).alias("epsg"))


@query("SELECT fid, 'bkt' || fid % 7 AS bucket FROM records")
def nm22_hosts(spark, d):
    url = F.concat(F.lit("https://bkt"), (F.col("fid") % 7).cast("string"), F.lit(".s3.eu-central-1.amazonaws.com/k"))
    return _records(spark, d).select("fid", text.route_columns(url)[1].alias("bucket"))


@query("SELECT fid, split_part(replace(assets.B04.href, 's3://', ''), '/', 2) AS part FROM records")
def nm23_split_part(spark, d):
    return _records(spark, d).select("fid", F.split_part(F.replace(F.col("assets.B04.href"), F.lit("s3://"), F.lit("")), F.lit("/"), F.lit(2)).alias("part"))


@query("SELECT fid, regexp_replace(coalesce(id, '') || CASE WHEN fid % 2 = 0 THEN '.SAFE' ELSE '' END, '\\.SAFE$', '') AS product FROM records")
def nm24_product(spark, d):
    raw = F.concat(F.coalesce("id", F.lit("")), F.when(F.col("fid") % 2 == 0, ".SAFE").otherwise(""))
    return _records(spark, d).select("fid", F.regexp_replace(raw, r"\.SAFE$", "").alias("product"))


@query()
def nm25_hash_split(spark, d):
    h = F.crc32(F.col("id").cast("binary")) % 100
    return _records(spark, d).filter("id IS NOT NULL").select("fid", F.when(h < 80, "train").when(h < 90, "val").otherwise("test").alias("split"))


@query("SELECT fid, CAST(floor((bbox.ymin + bbox.ymax) / 2 / 0.5) AS BIGINT) || '_' || CAST(floor((bbox.xmin + bbox.xmax) / 2 / 0.5) AS BIGINT) AS cell FROM records WHERE bbox IS NOT NULL")
def nm26_grid_cell(spark, d):
    b = F.col("bbox")
    f = lambda lo, hi: F.floor((lo + hi) / 2 / 0.5).cast("long").cast("string")
    return _records(spark, d).filter("bbox IS NOT NULL").select("fid", F.concat_ws("_", f(b.ymin, b.ymax), f(b.xmin, b.xmax)).alias("cell"))


# ---- geometry and grids -----------------------------------------------------------------------------------


@query("SELECT fid, bbox.xmax >= -20 AND bbox.xmin <= 40 AND bbox.ymax >= 30 AND bbox.ymin <= 60 AS hit FROM records WHERE bbox IS NOT NULL")
def gf03_bbox_intersects(spark, d):
    return _records(spark, d).filter("bbox IS NOT NULL").select("fid", P.bbox_overlaps(BOX).alias("hit"))


@query("SELECT point_index, round(CASE WHEN point_crs = 3857 THEN degrees(point_x / 6378137.0) ELSE point_x END, 7) AS lon, round(CASE WHEN point_crs = 3857 THEN degrees(atan(sinh(point_y / 6378137.0))) ELSE point_y END, 7) AS lat FROM points WHERE point_x IS NOT NULL AND point_y IS NOT NULL AND NOT isnan(point_x) AND NOT isnan(point_y) AND abs(point_y) < 2e7")
def gf07_transform_points(spark, d):
    p = _t(spark, d, "points").filter("point_x IS NOT NULL AND point_y IS NOT NULL AND NOT isnan(point_x) AND NOT isnan(point_y) AND abs(point_y) < 2e7")
    lon, lat = crs.lonlat_columns(F.col("point_x"), F.col("point_y"), F.when(F.col("point_crs") == 3857, 3857).otherwise(4326))
    return p.select("point_index", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


@query("SELECT fid, CASE WHEN regexp_full_match(trim(crs), '([Ee][Pp][Ss][Gg]:)?[0-9]+') THEN TRY_CAST(regexp_extract(trim(crs), '([0-9]+)$', 1) AS INT) END AS epsg FROM records")
def gf10_parse_epsg(spark, d):
    return _records(spark, d).select("fid", crs.epsg_column(F.col("crs")).alias("epsg"))


@query("SELECT fid, 'EPSG:' || \"proj:epsg\" AS code FROM records")
def gf11_crs_code(spark, d):
    return _records(spark, d).select("fid", crs.crs_code_column(P.name("proj:epsg")).alias("code"))


@query("SELECT point_index, row_number() OVER (ORDER BY point_index) - 1 AS seq FROM (SELECT DISTINCT point_index FROM points)")
def gf14_point_ids(spark, d):
    from scenegrain.operators.ids import numbered

    return numbered(_t(spark, d, "points").select("point_index").distinct(), ["point_index"], "seq")


@query("SELECT fid, 0.25 AS sx, bbox.xmin AS tx, -0.25 AS sy, bbox.ymax AS ty FROM records WHERE bbox IS NOT NULL")
def gf16_affine(spark, d):
    b = F.col("bbox")
    six = F.array(F.lit(0.25), F.lit(0.0), b.xmin, F.lit(0.0), F.lit(-0.25), b.ymax)
    t = affine.normalise_column(F.when(F.col("fid") % 2 == 0, six).otherwise(F.array(F.lit(0.25), b.xmin, F.lit(-0.25), b.ymax)))
    return _records(spark, d).filter("bbox IS NOT NULL").select("fid", t.alias("t")).select("fid", *[F.col("t")[i].alias(n) for i, n in enumerate(("sx", "tx", "sy", "ty"))])


@query("SELECT fid, greatest(1, CAST(ceil((bbox.ymax - bbox.ymin) / 0.01) AS BIGINT)) AS height, greatest(1, CAST(ceil((bbox.xmax - bbox.xmin) / 0.01) AS BIGINT)) AS width FROM records WHERE bbox IS NOT NULL")
def gf17_target_grid(spark, d):
    b = F.col("bbox")
    height, width = affine.target_shape_columns((b.xmin, b.ymin, b.xmax, b.ymax), (0.01, 0.01))
    return _records(spark, d).filter("bbox IS NOT NULL").select("fid", height.alias("height"), width.alias("width"))


@query("SELECT fid, CAST(round_even(CAST((bbox.ymax - bbox.ymin) / 0.01 AS DOUBLE), 0) AS BIGINT) AS height, CAST(round_even(CAST((bbox.xmax - bbox.xmin) / 0.01 AS DOUBLE), 0) AS BIGINT) AS width FROM records WHERE bbox IS NOT NULL")
def gf19_merge_grid(spark, d):
    b = F.col("bbox")
    height, width = affine.merge_shape_columns((b.xmin, b.ymin, b.xmax, b.ymax), (0.01, 0.01))
    return _records(spark, d).filter("bbox IS NOT NULL").select("fid", height.alias("height"), width.alias("width"))


@query("SELECT fid, least(tx, tx + 100 * 0.5) AS xmin, least(ty, ty + 200 * sy) AS ymin, greatest(tx, tx + 100 * 0.5) AS xmax, greatest(ty, ty + 200 * sy) AS ymax FROM (SELECT fid, bbox.xmin AS tx, bbox.ymax AS ty, CASE WHEN fid % 2 = 0 THEN 0.5 ELSE -0.5 END AS sy FROM records WHERE bbox IS NOT NULL)")
def gf20_pixel_bounds(spark, d):
    b = F.col("bbox")
    sy = F.when(F.col("fid") % 2 == 0, 0.5).otherwise(-0.5)
    cols = affine.bounds_columns(F.lit(0.5), b.xmin, sy, b.ymax, F.lit(100), F.lit(200))
    return _records(spark, d).filter("bbox IS NOT NULL").select("fid", *[c.alias(n) for c, n in zip(cols, ("xmin", "ymin", "xmax", "ymax"))])


@query("SELECT fid, round_even(CAST((bbox.xmin + bbox.xmax) / 2 / 0.25 AS DOUBLE), 0) * 0.25 - 0.125 AS xmin, round_even(CAST((bbox.ymin + bbox.ymax) / 2 / 0.25 AS DOUBLE), 0) * 0.25 + 0.125 AS ymax FROM records WHERE bbox IS NOT NULL")
def gf22_patch_box(spark, d):
    b = F.col("bbox")
    xmin, _, _, ymax = affine.patch_box_columns((b.xmin + b.xmax) / 2, (b.ymin + b.ymax) / 2, 0.25)
    return _records(spark, d).filter("bbox IS NOT NULL").select("fid", xmin.alias("xmin"), ymax.alias("ymax"))


def _with_box_wkb(df: DataFrame) -> DataFrame:
    """Footprints drawn from the boxes, for checks that SQL can follow."""
    b = F.col("bbox")
    return df.filter("bbox.xmin < bbox.xmax AND bbox.ymin < bbox.ymax").withColumn("geometry", normalize.box_wkb(b.xmin, b.ymin, b.xmax, b.ymax))


@query("SELECT fid, bbox.xmin AS xmin, bbox.ymin AS ymin, bbox.xmax AS xmax, bbox.ymax AS ymax FROM records WHERE bbox.xmin < bbox.xmax AND bbox.ymin < bbox.ymax")
def gf02_geometry_bounds(spark, d):
    r = _with_box_wkb(_records(spark, d).select("fid", "bbox")).drop("bbox")
    return normalize.geometry_bbox(r).select("fid", "bbox.*")


@query("SELECT fid, CASE WHEN fid % 3 > 0 THEN bbox.xmin END AS xmin FROM records WHERE bbox.xmin < bbox.xmax AND bbox.ymin < bbox.ymax")
def nm05_bbox_or_null(spark, d):
    r = _with_box_wkb(_records(spark, d).select("fid", "bbox")).drop("bbox")
    r = r.withColumn("geometry", F.when(F.col("fid") % 3 > 0, F.col("geometry")).otherwise(F.expr("X'0103'")))
    return normalize.geometry_bbox(r).select("fid", "bbox.xmin")


@query(f"SELECT DISTINCT point_index, fid FROM ({_PTS}) p JOIN records r ON lon >= r.bbox.xmin AND lon < r.bbox.xmax AND lat >= r.bbox.ymin AND lat < r.bbox.ymax WHERE bbox.xmin < bbox.xmax AND bbox.ymin < bbox.ymax")
def gf21_contains(spark, d):
    from scenegrain.operators import spatial

    r = _with_box_wkb(_records(spark, d).select("fid", "bbox"))
    prints, regs = spatial.footprints(r, "fid")
    hits = spatial.locate_points(_lonlat(spark, d), spatial.slab_table(regs))
    return hits.join(prints, "region").select(F.col("point").alias("point_index"), F.col("id").alias("fid")).distinct()


@query("SELECT fid, CASE fid % 4 WHEN 0 THEN 'h' WHEN 1 THEN 's' WHEN 2 THEN 'c' ELSE 'l' END || fid AS href FROM records")
def nm13_asset_href(spark, d):
    from scenegrain.ingest.enrich import asset_href

    k, n = F.col("fid") % 4, F.col("fid").cast("string")
    a = F.when(k == 0, F.concat(F.lit('{"href": "h'), n, F.lit('", "alternate": {"s3": {"href": "x"}}}'))).when(k == 1, F.concat(F.lit('{"alternate": {"https": {"href": "x"}, "s3": {"href": "s'), n, F.lit('"}}}')))
    a = a.when(k == 2, F.concat(F.lit('{"alternate": {"cloudfront": {"href": "c'), n, F.lit('"}}}'))).otherwise(F.concat(F.lit('{"links": [{"href": "l'), n, F.lit('"}]}')))
    return _records(spark, d).select("fid", asset_href(a).alias("href"))


@query("SELECT fid, assets.B04.href AS b04, assets.B08.href AS b08 FROM (SELECT fid, any_value(assets) AS assets FROM records WHERE assets IS NOT NULL GROUP BY fid)")
def nm16_band_columns(spark, d):
    from scenegrain.ingest.enrich import url_index, with_headers

    r = normalize.assets_map(_records(spark, d).select("fid", "assets").filter("assets IS NOT NULL")).dropDuplicates(["fid"])
    heads = url_index(r, "fid").select("href").distinct().select("href", F.struct(F.col("href").alias("file")).alias("header"))
    return with_headers(r, heads, ["B04", "B08"], "fid").select("fid", F.col("B04_metadata.file").alias("b04"), F.col("B08_metadata.file").alias("b08"))


@query(f"SELECT id, collection FROM ({_ITEMS}) ORDER BY datetime, id LIMIT 40")
def sc15_limited_items(spark, d):
    return stac.search(stac.items(_stac_json(spark, d), "item"), max_items=40).select("id", "collection")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
