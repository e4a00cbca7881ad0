"""Tiles, points, areas, mosaics and vectors.

Raster records and their decoded tiles are laid over ``embeddings``: four vectors of 64 values are the four 8 x 8
tiles of a 16 x 16 raster; rasters stand 12 map units apart, so that neighbours overlap; every thirteenth
value of a tile is nodata. Points come from ``customer``. The same definitions stand in the SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenegrain.operators import area, chips, points as pts, tiles, vectors
from scenegrain.operators.tiles import ring_offsets, square_offsets

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


RECS = """recs AS (SELECT rec, (rec % 25) * 12.0 AS tx, 16.0 + (rec // 25) * 12.0 AS ty, DATE '2024-01-01' + CAST(rec * 7 % 365 AS INT) AS dt FROM (SELECT DISTINCT vec_id // 4 AS rec FROM embeddings))"""
PIX = """pix AS (SELECT vec_id // 4 AS rec, ((vec_id % 4) // 2) * 8 + i // 8 AS row, (vec_id % 2) * 8 + i % 8 AS col, CASE WHEN i % 13 = 0 THEN -9999.0 ELSE round(CAST(embedding[i + 1] AS DOUBLE) * 1000) + 0.0 END AS value FROM embeddings, range(64) r(i))"""
PTS = """pts AS (SELECT c_custkey AS point_index, (c_custkey * 37 % 2500) / 8.0 AS x, (c_custkey * 53 % 700) / 8.0 AS y FROM customer)"""
BASE = f"""{RECS}, {PIX}, {PTS}, base AS (SELECT point_index, rec, dt, x - tx AS cf, ty - y AS rf, CAST(floor(ty - y) AS INT) AS row, CAST(floor(x - tx) AS INT) AS col FROM pts JOIN recs ON x BETWEEN tx AND tx + 16 AND y BETWEEN ty - 16 AND ty)"""
GRID = f"""{RECS}, {PIX}, gp AS (SELECT rec, dt, CAST(tx AS BIGINT) + col AS gx, CAST(ty AS BIGINT) - row - 1 AS gy, value, value <> -9999 AS valid FROM pix JOIN recs USING (rec))"""


def _records(spark, d):
    r = _t(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 4).cast("long").alias("record")).distinct()
    tx, ty = (F.col("record") % 25) * 12.0, F.floor(F.col("record") / 25) * 12.0 + 16.0
    one = lambda v, t="double": F.lit(v).cast(t)
    r = r.select("record", F.col("record").alias("seq"), one(1.0).alias("sx"), tx.alias("tx"), one(-1.0).alias("sy"), ty.alias("ty"), one(16, "int").alias("width"), one(16, "int").alias("height"), one(8, "int").alias("tile_w"), one(8, "int").alias("tile_h"), one(-9999.0).alias("nodata"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("record") * 7 % 365).cast("int")).cast("timestamp_ntz")
    return r.withColumn("datetime", day).withColumn("bbox", F.struct(F.col("tx").alias("xmin"), (F.col("ty") - 16).alias("ymin"), (F.col("tx") + 16).alias("xmax"), F.col("ty").alias("ymax")))


def _tiles(spark, d):
    v = F.transform("embedding", lambda e, i: F.when(i % 13 == 0, F.lit(-9999.0)).otherwise(F.round(e.cast("double") * 1000)))
    return _t(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 4).cast("long").alias("record"), F.floor((F.col("vec_id") % 4) / 2).cast("int").alias("tile_row"), (F.col("vec_id") % 2).cast("int").alias("tile_col"), v.alias("pixels"))


def _points(spark, d):
    k = F.col("c_custkey")
    return _t(spark, d, "customer").select(k.alias("point_index"), ((k * 37 % 2500) / 8.0).alias("x"), ((k * 53 % 700) / 8.0).alias("y"), "c_mktsegment")


# ---- tiles and ranges ---------------------------------------------------------------------------------


@query(f"WITH {RECS} SELECT rec AS record, r AS tile_row, c AS tile_col FROM recs, range(2) a(r), range(2) b(c) WHERE tx + 8 * c < 150.5 AND tx + 8 * c + 8 > 3.25 AND ty - 8 * r > 10.5 AND ty - 8 * r - 8 < 40.25")
def tp01_tiles_of_box(spark, d):
    box = [F.lit(v) for v in (3.25, 10.5, 150.5, 40.25)]
    return tiles.tiles_of_box(_records(spark, d), box).select("record", "tile_row", "tile_col")


@query("SELECT p_partkey, CAST(ceil((p_size * 100 + 7) / 256.0) AS INT) AS tiles_x FROM part")
def tp02_grid_shape(spark, d):
    return _t(spark, d, "part").select("p_partkey", tiles.grid_shape(F.col("p_size") * 100 + 7, F.lit(256)).alias("tiles_x"))


@query("SELECT vec_id, CASE WHEN k < 4 THEN 1000 + k * 128 END AS byte_offset, CASE WHEN k < 4 THEN 100 + k END AS bytes FROM (SELECT vec_id, vec_id % 6 AS k FROM embeddings)")
def tp03_tile_bytes(spark, d):
    k = F.col("vec_id") % 6
    off, size = F.array(*[F.lit(1000 + i * 128) for i in range(4)]), F.array(*[F.lit(100 + i) for i in range(4)])
    o, s = tiles.tile_bytes(off, size, F.floor(k / 2).cast("int"), (k % 2).cast("int"), F.lit(2))
    return _t(spark, d, "embeddings").select("vec_id", o.alias("byte_offset"), s.alias("bytes"))


@query(f"WITH {BASE} SELECT point_index, rec AS record, row, col, CASE WHEN row < 16 AND col < 16 THEN row // 8 ELSE -1 END AS tile_row, CASE WHEN row < 16 AND col < 16 THEN col // 8 ELSE -1 END AS tile_col FROM base")
def tp04_point_pixels(spark, d):
    from scenegrain.operators.range_join import points_in_boxes

    j = points_in_boxes(_points(spark, d), _records(spark, d), "x", "y", "bbox", 8.0)
    return j.withColumns(tiles.point_pixels(F.col("x"), F.col("y"))).select("point_index", "record", "row", "col", "tile_row", "tile_col")


_RANGES = "SELECT l_orderkey, CAST(l_partkey * 40 AS BIGINT) AS lo, CAST(l_partkey * 40 + l_quantity * 30 AS BIGINT) AS hi FROM lineitem"


@query(f"""WITH a AS ({_RANGES}), b AS (SELECT *, max(hi) OVER (PARTITION BY l_orderkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM a),
c AS (SELECT *, sum(CASE WHEN before IS NULL OR lo > before + 1024 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM b)
SELECT l_orderkey, min(lo) AS lo, max(hi) AS hi, count(*) AS requests FROM c GROUP BY l_orderkey, g""")
def wn02_merge_ranges(spark, d):
    r = _t(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") * 40).alias("lo"), (F.col("l_partkey") * 40 + F.col("l_quantity") * 30).cast("long").alias("hi"))
    return tiles.merged(r, ["l_orderkey"], "lo", "hi").select("l_orderkey", "lo", "hi", "requests")


@query(f"""WITH a AS ({_RANGES}), b AS (SELECT *, max(hi) OVER (PARTITION BY l_orderkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM a),
c AS (SELECT *, sum(CASE WHEN before IS NULL OR lo > before + 1024 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM b)
SELECT l_orderkey, lo, hi, CAST(g - 1 AS INT) AS range, lo - min(lo) OVER (PARTITION BY l_orderkey, g) AS slice_at FROM c""")
def tp06_assign_ranges(spark, d):
    r = _t(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") * 40).alias("lo"), (F.col("l_partkey") * 40 + F.col("l_quantity") * 30).cast("long").alias("hi"))
    m = tiles.merge_ranges(r, ["l_orderkey"], "lo", "hi")
    return m.withColumn("slice_at", F.col("lo") - F.min("lo").over(Window.partitionBy("l_orderkey", "range")))


@query(f"WITH {RECS} SELECT rec AS record, greatest(0, CAST(floor(ty - 40.25) AS INT)) AS row_start, least(16, CAST(ceil(ty - 10.5) AS INT)) AS row_stop, greatest(0, CAST(floor(3.25 - tx) AS INT)) AS col_start, least(16, CAST(ceil(150.5 - tx) AS INT)) AS col_stop FROM recs")
def tp08_windows(spark, d):
    box = [F.lit(v) for v in (3.25, 10.5, 150.5, 40.25)]
    return _records(spark, d).withColumns(tiles.window_of_box(box)).select("record", "row_start", "row_stop", "col_start", "col_stop")


@query("SELECT vec_id, count(*) FILTER (r < 13 AND c < 11) AS real FROM embeddings, range(8) a(i), range(8) b(j), LATERAL (SELECT ((vec_id % 4) // 2) * 8 + i AS r, (vec_id % 2) * 8 + j AS c) GROUP BY vec_id")
def tp09_coverage(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    r = F.floor((F.col("vec_id") % 4) / 2) * 8 + F.floor(F.col("pos") / 8)
    c = F.col("vec_id") % 2 * 8 + F.col("pos") % 8
    e = e.select("vec_id", r.alias("r"), c.alias("c"), F.lit(13).alias("height"), F.lit(11).alias("width"))
    return e.groupBy("vec_id").agg(F.count_if(tiles.coverage(F.col("r"), F.col("c"))).alias("real"))


@query(f"""WITH {BASE}, need AS (SELECT DISTINCT rec, r // 8 AS tr, c // 8 AS tc FROM (SELECT rec, row + dr AS r, col + dc AS c FROM base, (VALUES {', '.join(map(str, ring_offsets(1)))}) o(dr, dc) WHERE row < 16 AND col < 16) WHERE r BETWEEN 0 AND 15 AND c BETWEEN 0 AND 15),
held AS (SELECT DISTINCT rec, row // 8 AS tr, col // 8 AS tc FROM base WHERE row < 16 AND col < 16)
SELECT rec AS record, tr AS tile_row, tc AS tile_col FROM need EXCEPT SELECT rec, tr, tc FROM held""")
def tp10_extra_tiles(spark, d):
    j = pts.candidates(_points(spark, d), _records(spark, d), cell=8.0)
    ring = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in ring_offsets(1)])
    n = j.select("record", "row", "col", "height", "width", F.explode(ring).alias("o")).withColumns({"r": F.col("row") + F.col("o.dr"), "c": F.col("col") + F.col("o.dc")})
    n = n.filter("r >= 0 AND c >= 0 AND r < height AND c < width").select("record", F.floor(F.col("r") / 8).cast("int").alias("tile_row"), F.floor(F.col("c") / 8).cast("int").alias("tile_col")).distinct()
    return n.join(j.select("record", "tile_row", "tile_col").distinct(), ["record", "tile_row", "tile_col"], "left_anti")


@query(f"WITH {BASE} SELECT rec AS record, row // 8 AS tile_row, col // 8 AS tile_col, count(*) AS n, min(point_index) AS first FROM base WHERE row < 16 AND col < 16 GROUP BY ALL")
def ag06_tile_groups(spark, d):
    j = pts.candidates(_points(spark, d), _records(spark, d), cell=8.0)
    return j.groupBy("record", "tile_row", "tile_col").agg(F.count("*").alias("n"), F.min("point_index").alias("first"))


@query(f"WITH {BASE} SELECT DISTINCT row // 8 AS tile_row, col // 8 AS tile_col FROM base WHERE row < 16 AND col < 16")
def ag07_tile_pairs(spark, d):
    return pts.candidates(_points(spark, d), _records(spark, d), cell=8.0).select("tile_row", "tile_col").distinct()


@query("SELECT rec % 25 AS source, count(*) AS bands, min(rec) AS first FROM (SELECT DISTINCT vec_id // 4 AS rec FROM embeddings) GROUP BY 1")
def ag08_band_sources(spark, d):
    r = _records(spark, d).groupBy((F.col("record") % 25).alias("source"), "width", "height", "tile_w", "tile_h").agg(F.count("*").alias("bands"), F.min("record").alias("first"))
    return r.select("source", "bands", "first")


@query("SELECT vec_id, CASE WHEN vec_id % 5 = 4 THEN NULL ELSE (vec_id % 3) * 4 * 10 END AS first_offset, CASE WHEN vec_id % 5 = 4 THEN NULL ELSE 4 END AS n FROM embeddings")
def nm15_plane_slices(spark, d):
    from scenegrain.ingest.enrich import slice_tables

    table = F.when(F.col("vec_id") % 5 == 4, F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: i * 10)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: i * 10))
    s = slice_tables(table, (F.col("vec_id") % 3).cast("int"), F.lit(4))
    return _t(spark, d, "embeddings").select("vec_id", s.alias("s")).select("vec_id", F.get("s", F.lit(0)).alias("first_offset"), F.when(F.col("s").isNotNull(), F.size("s")).alias("n"))


@query(f"WITH {PIX} SELECT rec AS record, row, col, value FROM pix")
def dc04_merge_tiles(spark, d):
    t = _tiles(spark, d).join(_records(spark, d).select("record", "width", "height", "tile_w", "tile_h"), "record")
    return tiles.pixels_of_tiles(t).select("record", "row", "col", "value")


@query(f"WITH {RECS} SELECT rec AS record, 100.0 + rec - 2 * 0.5 - 0.25 AS tx, 50.0 + 3 * 0.5 + 0.25 AS ty FROM recs")
def dc05_tiepoints(spark, d):
    from scenegrain.tiff.header import tiepoint_columns

    c = tiepoint_columns(F.lit(0.5), F.lit(0.5), F.lit(2.0), F.lit(3.0), F.col("record") + 100.0, F.lit(50.0), F.lit(2))
    return _records(spark, d).select("record", c[1].alias("tx"), c[3].alias("ty"))


# ---- points ---------------------------------------------------------------------------------------------

_VALUE = "FROM base JOIN pix USING (rec, row, col)"


@query(f"WITH {BASE} SELECT point_index, rec AS record, value {_VALUE}")
def pt02_sample_all(spark, d):
    return pts.sample(_points(spark, d), _records(spark, d), _tiles(spark, d), cell=8.0).select("point_index", "record", "value")


@query(f"WITH {BASE}, win AS (SELECT * FROM base QUALIFY row_number() OVER (PARTITION BY point_index ORDER BY dt DESC, rec) = 1) SELECT point_index, rec AS record, value FROM win JOIN pix USING (rec, row, col)")
def pt03_sample_latest(spark, d):
    return pts.sample(_points(spark, d), _records(spark, d), _tiles(spark, d), match="latest", cell=8.0).select("point_index", "record", "value")


_RINGS = ", ".join(str((r, k, *o)) for r in (1, 2) for k, o in enumerate(ring_offsets(r)))
_FALL = f"""{BASE}, b AS (SELECT * {_VALUE}), near AS (
 SELECT point_index, b.rec, radius, k, pix.value, pow(greatest(b.row + dr - rf, rf - (b.row + dr) - 1, 0), 2) + pow(greatest(b.col + dc - cf, cf - (b.col + dc) - 1, 0), 2) AS dist
 FROM b, (VALUES {_RINGS}) o(radius, k, dr, dc), pix WHERE b.value = -9999 AND pix.rec = b.rec AND pix.row = b.row + dr AND pix.col = b.col + dc AND pix.value <> -9999),
best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY point_index, rec ORDER BY radius, dist, k) = 1)"""


@query(f"WITH {_FALL} SELECT b.point_index, b.rec AS record, coalesce(best.value, b.value) AS value FROM b LEFT JOIN best USING (point_index, rec)")
def pt05_fallback(spark, d):
    return pts.sample(_points(spark, d), _records(spark, d), _tiles(spark, d), max_distance=2, cell=8.0).select("point_index", "record", "value")


@query(f"WITH {_FALL} SELECT point_index, rec AS record, radius, value FROM best")
def wn03_nearest_valid(spark, d):
    b = pts.sample(_points(spark, d), _records(spark, d), _tiles(spark, d), cell=8.0).filter(F.col("value") == F.col("nodata"))
    offsets = F.array(*[F.struct(F.lit(r).alias("radius"), F.lit(k).alias("k"), F.lit(a).alias("dr"), F.lit(c).alias("dc")) for r in (1, 2) for k, (a, c) in enumerate(ring_offsets(r))])
    n = b.drop("value").withColumn("o", F.explode(offsets)).withColumns({"r2": F.col("row") + F.col("o.dr"), "c2": F.col("col") + F.col("o.dc")}).filter("r2 >= 0 AND c2 >= 0 AND r2 < height AND c2 < width")
    n = pts._read(n, _tiles(spark, d), "r2", "c2", "inner").filter(~tiles.is_nodata(F.col("v_"), F.col("nodata")))
    w = Window.partitionBy("point_index", "record").orderBy("o.radius", pts.rect_distance_sq("r2", "c2"), "o.k")
    return n.withColumn("n", F.row_number().over(w)).filter("n = 1").select("point_index", "record", "o.radius", F.col("v_").alias("value"))


_SQUARE = ", ".join(str((k, *o)) for k, o in enumerate(square_offsets(1)))


@query(f"""WITH {BASE}, b AS (SELECT * {_VALUE}) SELECT b.point_index, b.rec AS record, string_agg(coalesce(CAST(CAST(pix.value AS INT) AS VARCHAR), 'x'), ',' ORDER BY k) AS hood
FROM b CROSS JOIN (VALUES {_SQUARE}) o(k, dr, dc) LEFT JOIN pix ON pix.rec = b.rec AND pix.row = b.row + dr AND pix.col = b.col + dc GROUP BY ALL""")
def pt08_neighbourhood(spark, d):
    s = pts.sample(_points(spark, d), _records(spark, d), _tiles(spark, d), max_distance=1, neighbourhood="always", cell=8.0)
    text = F.array_join(F.transform("neighbourhood_values", lambda v: F.when(F.isnan(v), "x").otherwise(v.cast("int").cast("string"))), ",")
    return s.select("point_index", "record", text.alias("hood"))


@query(f"WITH {BASE} SELECT point_index, rec AS record, value = -9999 AS empty {_VALUE}")
def pt09_nodata_mask(spark, d):
    s = pts.sample(_points(spark, d), _records(spark, d), _tiles(spark, d), cell=8.0)
    return s.select("point_index", "record", tiles.is_nodata(F.col("value"), F.col("nodata")).alias("empty"))


@query(f"WITH {RECS}, {PTS} SELECT rec AS record FROM recs WHERE EXISTS (SELECT 1 FROM pts WHERE x BETWEEN tx AND tx + 16 AND y BETWEEN ty - 16 AND ty)")
def pt10_narrowed(spark, d):
    from scenegrain.operators.range_join import overlap_semi_join

    box = F.struct(F.col("x").alias("xmin"), F.col("y").alias("ymin"), F.col("x").alias("xmax"), F.col("y").alias("ymax"))
    return overlap_semi_join(_records(spark, d), _points(spark, d).select(box.alias("bbox")), 8.0).select("record")


@query(f"WITH {BASE} SELECT point_index, x AS point_x, y AS point_y, CAST(4326 AS INT) AS point_crs, CAST(rec AS VARCHAR) AS record_id, CAST(dt AS TIMESTAMP) AS datetime, '' AS collection, 'B1' AS band, value, CAST(NULL AS INT) AS raster_crs, c_mktsegment FROM (SELECT * {_VALUE}) JOIN pts USING (point_index) JOIN customer ON c_custkey = point_index")
def pt14_contract(spark, d):
    return pts.to_contract(pts.sample(_points(spark, d), _records(spark, d), _tiles(spark, d), cell=8.0), "B1", metadata=["c_mktsegment"])


@query(f"WITH {BASE} SELECT point_index, rec AS record FROM base QUALIFY row_number() OVER (PARTITION BY point_index ORDER BY dt DESC, rec) = 1 AND row < 16 AND col < 16")
def wn01_latest(spark, d):
    return pts.candidates(_points(spark, d), _records(spark, d), match="latest", cell=8.0).select("point_index", "record")


@query("SELECT " + ", ".join(f"'{r}:{k}' AS o{r}_{k}, {a} AS r{r}_{k}, {b} AS c{r}_{k}" for r in (1,) for k, (a, b) in enumerate(((-1, -1), (-1, 0), (-1, 1), (1, -1), (1, 0), (1, 1), (0, -1), (0, 1)))))
def pt06_ring_order(spark, d):
    o = ring_offsets(1)
    return spark.range(1).select(*[x for k, (a, b) in enumerate(o) for x in (F.lit(f"1:{k}").alias(f"o1_{k}"), F.lit(a).alias(f"r1_{k}"), F.lit(b).alias(f"c1_{k}"))])


@query(f"WITH {BASE} SELECT point_index, rec AS record, pow(greatest(0 - rf, rf - 1, 0), 2) + pow(greatest(0 - cf, cf - 1, 0), 2) AS d FROM base WHERE row < 16 AND col < 16")
def pt07_rect_distance(spark, d):
    j = pts.candidates(_points(spark, d), _records(spark, d), cell=8.0).withColumns({"r2": F.lit(0), "c2": F.lit(0)})
    return j.select("point_index", "record", pts.rect_distance_sq("r2", "c2").alias("d"))


# ---- areas ----------------------------------------------------------------------------------------------

AOIS = "aois AS (SELECT i AS geometry_id, 2.25 + 29.5 * i AS x0, 5.5 AS y0, 2.25 + 29.5 * i + 9.5 AS x1, 22.75 AS y1 FROM range(10) a(i))"


def _aois(spark):
    x0 = F.col("id") * 29.5 + 2.25
    box = F.struct(x0.alias("xmin"), F.lit(5.5).alias("ymin"), (x0 + 9.5).alias("xmax"), F.lit(22.75).alias("ymax"))
    return spark.range(10).select(F.col("id").alias("geometry_id"), box.alias("aoi"))


_AREA = f"""{RECS}, {PIX}, {AOIS}, ap AS (SELECT rec, geometry_id, row, col, value, tx + col + 0.5 >= x0 AND tx + col + 0.5 < x1 AND ty - row - 0.5 >= y0 AND ty - row - 0.5 < y1 AS inside
FROM recs JOIN aois ON tx <= x1 AND tx + 16 >= x0 AND ty - 16 <= y1 AND ty >= y0 JOIN pix USING (rec) WHERE col >= floor(x0 - tx) AND col < ceil(x1 - tx) AND row >= floor(ty - y1) AND row < ceil(ty - y0))"""


@query(f"WITH {_AREA} SELECT rec AS record, geometry_id, count(*) FILTER (inside AND value <> -9999) AS n, min(value) FILTER (inside AND value <> -9999) AS lowest, max(value) FILTER (inside AND value <> -9999) AS highest, sum(value) FILTER (inside AND value <> -9999) AS total FROM ap GROUP BY ALL")
def px01_area_read(spark, d):
    return area.zonal(area.area_pixels(_records(spark, d), _aois(spark), _tiles(spark, d)))


@query(f"WITH {_AREA} SELECT rec AS record, geometry_id, count(*) FILTER (inside) AS inside, count(*) AS pixels FROM ap GROUP BY ALL")
def px02_mask(spark, d):
    p = area.area_pixels(_records(spark, d), _aois(spark), _tiles(spark, d))
    return p.groupBy("record", "geometry_id").agg(F.count_if("inside").alias("inside"), F.count("*").alias("pixels"))


@query(f"WITH {RECS}, {PIX} SELECT recs.rec AS record, i AS row, j AS col, coalesce(value, -1.0) AS value FROM recs CROSS JOIN range(-4, 20) a(i) CROSS JOIN range(-4, 20) b(j) LEFT JOIN pix ON pix.rec = recs.rec AND row = i AND col = j")
def px03_boundless(spark, d):
    """A window four pixels larger than each raster: what lies outside is filled."""
    r = _records(spark, d)
    p = tiles.pixels_of_tiles(_tiles(spark, d).join(r, "record")).select("record", "row", "col", "value")
    span = F.sequence(F.lit(-4), F.lit(19))
    q = r.select("record", F.explode(span).alias("row")).select("record", "row", F.explode(span).alias("col"))
    return q.join(p, ["record", "row", "col"], "left").select("record", "row", "col", F.coalesce("value", F.lit(-1.0)).alias("value"))


@query(f"WITH {_AREA} SELECT rec AS record, geometry_id, CAST(max(row) - min(row) + 1 AS INT) AS height, CAST(max(col) - min(col) + 1 AS INT) AS width, string_agg(CAST(CAST(CASE WHEN inside THEN value ELSE -9999 END AS INT) AS VARCHAR), ',' ORDER BY row, col) AS data FROM ap GROUP BY ALL")
def px05_frame(spark, d):
    f = area.area_frame(area.area_pixels(_records(spark, d), _aois(spark), _tiles(spark, d)))
    return f.select("record", "geometry_id", "height", "width", F.array_join(F.transform("data", lambda v: v.cast("int").cast("string")), ",").alias("data"))


@query(f"WITH {_AREA} SELECT geometry_id, count(DISTINCT rec) AS samples, count(DISTINCT (h, w)) AS shapes FROM (SELECT rec, geometry_id, max(row) - min(row) AS h, max(col) - min(col) AS w FROM ap GROUP BY ALL) GROUP BY ALL")
def px04_stack(spark, d):
    f = area.area_frame(area.area_pixels(_records(spark, d), _aois(spark), _tiles(spark, d)))
    return f.groupBy("geometry_id").agg(F.count_distinct("record").alias("samples"), F.count_distinct("height", "width").alias("shapes"))


@query(f"WITH {GRID} SELECT gx, gy, arg_min(value, rec) FILTER (valid) AS value FROM gp GROUP BY gx, gy")
def px06_combine_first(spark, d):
    return area.combine_first(area.map_pixels(_records(spark, d), _tiles(spark, d)), ["record"])


@query(f"WITH {GRID}, ch AS (SELECT i AS chip, 6 + 20 * i AS cx, 3 AS cy FROM range(15) a(i)), m AS (SELECT gx, gy, arg_min(value, rec) FILTER (valid) AS value FROM gp GROUP BY gx, gy) SELECT chip, cx + i % 8 AS gx, cy + i // 8 AS gy, coalesce(value, 0.0) AS value FROM ch CROSS JOIN range(64) s(i) LEFT JOIN m ON m.gx = cx + i % 8 AND m.gy = cy + i // 8")
def px08_on_grid(spark, d):
    m = area.combine_first(area.map_pixels(_records(spark, d), _tiles(spark, d)), ["record"])
    c = spark.range(15).select(F.col("id").alias("chip"), (F.col("id") * 20 + 6).alias("cx"), F.lit(3).cast("long").alias("cy"))
    return area.on_grid(m, c, 8).select("chip", "gx", "gy", "value")


@query(f"WITH {RECS} SELECT rec AS record, CAST(tx AS VARCHAR) || ' 1.0 0.0 ' || CAST(ty AS VARCHAR) || ' 0.0 -1.0' AS geotransform FROM (SELECT rec, CAST(tx AS DOUBLE) AS tx, CAST(ty AS DOUBLE) AS ty FROM recs)")
def px11_geotransform(spark, d):
    return _records(spark, d).select("record", F.concat_ws(" ", F.col("tx").cast("string"), F.lit("1.0"), F.lit("0.0"), F.col("ty").cast("string"), F.lit("0.0"), F.lit("-1.0")).alias("geotransform"))


@query(f"WITH {RECS} SELECT rec AS record, tx AS xmin, ty - 16 AS ymin, tx + 16 AS xmax, ty AS ymax FROM (SELECT rec, CAST(tx AS DOUBLE) AS tx, CAST(ty AS DOUBLE) AS ty FROM recs) WHERE tx < 100 AND ty > 20")
def px12_footprints(spark, d):
    from scenegrain.functions.affine import bounds_columns

    b = bounds_columns(*[F.col(c) for c in ("sx", "tx", "sy", "ty", "width", "height")])
    return _records(spark, d).filter("tx < 100 AND ty > 20").select("record", *[c.alias(n) for c, n in zip(b, ("xmin", "ymin", "xmax", "ymax"))])


@query(f"WITH {GRID}, ch AS (SELECT i AS chip, 6 + 20 * i AS cx, 3 AS cy FROM range(15) a(i)) SELECT chip, count(DISTINCT rec) AS times, sum(value) FILTER (valid) AS total FROM ch JOIN gp ON gx >= cx AND gx < cx + 8 AND gy >= cy AND gy < cy + 8 WHERE dt > DATE '2024-02-01' AND dt <= DATE '2024-12-01' GROUP BY chip")
def px13_time_stack(spark, d):
    r = _records(spark, d).filter(chips.in_slice(F.col("datetime"), "2024-02-01", "2024-12-01"))
    x0 = F.col("id") * 20.0 + 6
    box = F.struct(x0.alias("xmin"), F.lit(3.0).alias("ymin"), (x0 + 8).alias("xmax"), F.lit(11.0).alias("ymax"))
    p = area.area_pixels(r, spark.range(15).select(F.col("id").alias("geometry_id"), box.alias("aoi")), _tiles(spark, d), touching=False)
    return p.groupBy(F.col("geometry_id").alias("chip")).agg(F.count_distinct("record").alias("times"), F.sum(F.when(F.col("valid"), F.col("value"))).alias("total"))


@query(f"WITH {_AREA} SELECT geometry_id, bool_and(n = h * w) AS complete FROM (SELECT rec, geometry_id, count(*) AS n, max(row) - min(row) + 1 AS h, max(col) - min(col) + 1 AS w FROM ap GROUP BY ALL) GROUP BY ALL")
def px14_complete(spark, d):
    f = area.area_frame(area.area_pixels(_records(spark, d), _aois(spark), _tiles(spark, d)))
    return f.groupBy("geometry_id").agg(F.bool_and("complete").alias("complete"))


@query(f"WITH {PIX} SELECT rec AS record, count(*) FILTER (value <> -9999) AS valid FROM pix GROUP BY rec")
def px16_valid_mask(spark, d):
    p = tiles.pixels_of_tiles(_tiles(spark, d).join(_records(spark, d), "record"))
    return p.groupBy("record").agg(F.count_if(~tiles.is_nodata(F.col("value"), F.col("nodata"))).alias("valid"))


@query(f"WITH {PIX} SELECT rec AS record, count(*) FILTER (value >= 100) AS above FROM pix GROUP BY rec")
def px17_threshold(spark, d):
    p = tiles.pixels_of_tiles(_tiles(spark, d).join(_records(spark, d), "record"))
    return p.groupBy("record").agg(F.count_if(F.col("value") >= 100).alias("above"))


@query("SELECT x + 7 * y AS chip, x * 10.0 + 1 AS xmin, y * 10.0 + 2 AS ymin, x * 10.0 + 17 AS xmax, y * 10.0 + 18 AS ymax FROM range(7) a(x), range(3) b(y)")
def px18_grid_chips(spark, d):
    return chips.grid_chips(spark, (1.0, 2.0, 80.0, 45.0), 16.0, 10.0)


@query(f"WITH {BASE} SELECT rec AS record, row // 8 AS tile_row, col // 8 AS tile_col, count(*) AS n, sum(value) AS total {_VALUE} GROUP BY ALL")
def jn06_requests_to_tiles(spark, d):
    s = pts.sample(_points(spark, d), _records(spark, d), _tiles(spark, d), cell=8.0)
    return s.groupBy("record", "tile_row", "tile_col").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(f"WITH {GRID} SELECT gx, gy, coalesce(arg_min(value, rec) FILTER (valid), 0.0) AS value FROM gp GROUP BY gx, gy")
def wn04_mosaic(spark, d):
    return area.first_valid(area.map_pixels(_records(spark, d), _tiles(spark, d)), ["record"])


@query(f"WITH {GRID} SELECT gx, gy, arg_min(value, (dt, rec)) FILTER (valid) AS value FROM gp GROUP BY gx, gy")
def wn05_combine_by_time(spark, d):
    return area.combine_first(area.map_pixels(_records(spark, d), _tiles(spark, d)), ["datetime", "record"])


@query(f"WITH {RECS} SELECT rec AS record, dense_rank() OVER (ORDER BY dt) - 1 AS t, FALSE AS flip FROM recs")
def wn06_time_order(spark, d):
    return area.time_order(_records(spark, d).select("record", "datetime", "sy"), "datetime").select("record", F.col("t").cast("long").alias("t"), "flip")


@query(f"WITH {GRID} SELECT gx, gy, rec AS label FROM gp WHERE valid QUALIFY row_number() OVER (PARTITION BY gx, gy ORDER BY dt, rec) = 1")
def wn12_first_readable(spark, d):
    p = area.map_pixels(_records(spark, d), _tiles(spark, d)).withColumn("label", F.col("record"))
    return area.first_readable(p, ["gx", "gy"], ["datetime", "record"], F.col("valid"), "label").filter("label IS NOT NULL")


@query(f"WITH {GRID} SELECT gx, gy, arg_max(value, rec) AS last, round(avg(value) FILTER (valid), 6) AS mean FROM gp GROUP BY gx, gy")
def sk09_stitch(spark, d):
    p = area.map_pixels(_records(spark, d), _tiles(spark, d))
    last = area.last_wins(p, ["record"]).withColumnRenamed("value", "last")
    return last.join(area.mean_of_overlaps(p), ["gx", "gy"]).select("gx", "gy", "last", F.round("value", 6).alias("mean"))


def _archive(spark, d):
    """The rasters as real files: tiled GeoTIFFs in the shared folder, and a collection that names them."""
    import os
    from urllib.parse import urlparse

    import numpy as np
    import pyarrow as pa

    from scenegrain.collection import Collection
    from scenegrain.ingest.normalize import ASSETS
    from scenegrain.session import scratch_path
    from scenegrain.tiff.write import write

    at = scratch_path(spark, "archive")
    folder = urlparse(at).path if at.startswith("file:") else at
    rows = _tiles(spark, d).groupBy("record").agg(F.array_sort(F.collect_list(F.struct("tile_row", "tile_col", "pixels"))).alias("tiles"))
    grid = rows.join(_records(spark, d).select("record", "tx", "ty"), "record")

    def save(batches):
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            names = []
            for q in b.to_pylist():
                a = np.empty((16, 16), "int16")
                for t in q["tiles"]:
                    a[t["tile_row"] * 8 : t["tile_row"] * 8 + 8, t["tile_col"] * 8 : t["tile_col"] * 8 + 8] = np.reshape(t["pixels"], (8, 8))
                names.append(f"{folder}/{q['record']}.tif")
                write(names[-1], a, transform=(1.0, q["tx"], -1.0, q["ty"]), tile=8, compression=8, predictor=2, nodata=-9999)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string())], names=["record", "href"])

    from scenegrain.session import settled

    files = settled(spark, grid.mapInArrow(save, "record long, href string"), "files")
    r = _records(spark, d).join(files, "record")
    a = F.create_map(F.lit("B1"), F.struct("href", F.lit(0).alias("band_index"))).cast(ASSETS)
    return Collection(r.select(F.col("record").cast("string").alias("id"), "datetime", F.lit(None).cast("binary").alias("geometry"), a.alias("assets"), "bbox"), "archive")


@query(f"WITH {BASE} SELECT point_index, CAST(rec AS VARCHAR) AS record_id, value, c_mktsegment {_VALUE} JOIN customer ON c_custkey = point_index")
def pt01_sample_files(spark, d):
    """From files: headers, byte ranges, tiles and all."""
    s = _archive(spark, d).sample_points(_points(spark, d), ["B1"], index="point_index", cell=8.0)
    return s.select("point_index", "record_id", "value", "c_mktsegment")


@query(f"WITH {BASE} SELECT point_index, rec AS record, value {_VALUE} WHERE value <> -9999")
def pt04_valid_values(spark, d):
    s = pts.sample(_points(spark, d), _records(spark, d), _tiles(spark, d), cell=8.0)
    return s.filter(~tiles.is_nodata(F.col("value"), F.col("nodata"))).select("point_index", "record", "value")


@query(f"WITH {_AREA} SELECT CAST(rec AS VARCHAR) AS record, geometry_id, count(*) FILTER (inside AND value <> -9999) AS n, sum(value) FILTER (inside AND value <> -9999) AS total FROM ap GROUP BY ALL HAVING count(*) FILTER (inside AND value <> -9999) > 0")
def px10_read_files(spark, d):
    """Areas from files, as a table of pixels."""
    from scenegrain import read
    from scenegrain.ingest.normalize import box_wkb

    b = F.col("aoi")
    aois = _aois(spark).select("geometry_id", box_wkb(b.xmin, b.ymin, b.xmax, b.ymax).alias("geometry"))
    p = read.long_pixels(_archive(spark, d).area_frame(aois, ["B1"], partitions=8, cell=8.0))
    return p.groupBy("record", "geometry_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


# ---- vectors ----------------------------------------------------------------------------------------------

LONG = "lng AS (SELECT vec_id, label, i AS pos, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(64) r(i))"


def _long(spark, d):
    return vectors.long_form(_t(spark, d, "embeddings"), ["vec_id", "label"], "embedding")


@query("SELECT vec_id AS point_index, round(CAST(embedding[1] AS DOUBLE), 6) AS b0, round(CAST(embedding[2] AS DOUBLE), 6) AS b1, round(CAST(embedding[64] AS DOUBLE), 6) AS b63 FROM embeddings")
def ag11_pivot(spark, d):
    w = vectors.pivot_wide(_long(spark, d), "vec_id", "pos", "v", [0, 1, 63])
    return w.select(F.col("vec_id").alias("point_index"), *[F.round(str(k), 6).alias(f"b{k}") for k in (0, 1, 63)])


@query(f"WITH {LONG} SELECT label, pos, round(avg(v), 6) AS mean FROM lng GROUP BY ALL")
def ag12_nan_mean(spark, d):
    return vectors.nan_mean(_long(spark, d), ["label"]).select("label", "pos", F.round("mean", 6).alias("mean"))


@query(f"WITH {LONG}, g AS (SELECT label, pos, avg(sign(v)) * pow(avg(pow(abs(v), 3)), 1.0 / 3) AS q FROM lng GROUP BY ALL) SELECT label, pos, round(q / sqrt(sum(q * q) OVER (PARTITION BY label)), 5) AS pooled FROM g")
def ag13_gem(spark, d):
    return vectors.gem_pool(_long(spark, d), ["label"]).select("label", "pos", F.round("pooled", 5).alias("pooled"))


@query(f"WITH {LONG}, g AS (SELECT pos, avg(v) FILTER (label = 1) - avg(v) FILTER (label = 2) AS q FROM lng GROUP BY pos) SELECT pos, round(q / sqrt(sum(q * q) OVER ()), 5) AS d FROM g")
def ag14_prototype(spark, d):
    return vectors.prototype(_long(spark, d), "label", 1, 2).select("pos", F.round("d", 5).alias("d"))


@query("SELECT vec_id, s >= (SELECT quantile_cont(s, 0.9) FROM q) AS predicted FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS s FROM embeddings) JOIN (SELECT 1) ON TRUE".replace("FROM q)", "FROM (SELECT CAST(embedding[1] AS DOUBLE) AS s FROM embeddings))"))
def ag15_threshold(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("s"))
    return vectors.threshold(e, "s", 90).select("vec_id", "predicted")


@query("SELECT *, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall FROM (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM (SELECT label = 3 AS t, embedding[1] > 0 AS p FROM embeddings))")
def ag16_confusion(spark, d):
    e = _t(spark, d, "embeddings").select((F.col("label") == 3).alias("t"), (F.col("embedding")[0] > 0).alias("p"))
    return vectors.confusion(e, "t", "p").withColumns({c: F.round(c, 9) for c in ("precision", "recall")})


@query(f"WITH {LONG} SELECT label, min(v) AS lowest, round(avg(v), 6) AS mean, max(v) AS highest, count(v) AS n FROM lng GROUP BY label")
def ag17_stats(spark, d):
    return vectors.finite_stats(_long(spark, d), "v", ["label"]).withColumn("mean", F.round("mean", 6))


@query(f"WITH {LONG} SELECT vec_id, pos, CASE WHEN q = -128 THEN 'NaN'::DOUBLE ELSE round(pow(q / 127.5, 2) * sign(q), 6) END AS v FROM (SELECT vec_id, pos, CASE WHEN pos % 17 = 0 THEN -128 ELSE round(v * 100) END AS q FROM lng)")
def nm28_dequantise(spark, d):
    q = F.when(F.col("pos") % 17 == 0, F.lit(-128.0)).otherwise(F.round(F.col("v") * 100))
    return _long(spark, d).select("vec_id", "pos", F.round(vectors.dequantise(q), 6).alias("v"))


_SIM = "SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


def _sims(spark, d):
    e = _t(spark, d, "embeddings")
    q = F.array(*map(F.lit, e.filter("vec_id = 0").first().embedding))
    return e.select("vec_id", F.round(vectors.cosine(F.col("embedding"), q), 6).alias("similarity"))


@query(_SIM)
def nm29_cosine(spark, d):
    return _sims(spark, d)


@query(f"SELECT vec_id, round(1 - (1 - similarity), 6) AS score FROM ({_SIM})")
def nm30_score(spark, d):
    return _sims(spark, d).select("vec_id", F.round(1 - (1 - F.col("similarity")), 6).alias("score"))


@query(f"SELECT vec_id, round(1 - similarity, 6) AS distance FROM ({_SIM}) ORDER BY similarity DESC, vec_id LIMIT 10")
def wn08_top_k(spark, d):
    return _sims(spark, d).orderBy(F.desc("similarity"), "vec_id").limit(10).select("vec_id", F.round(1 - F.col("similarity"), 6).alias("distance"))


@query(f"WITH {PIX} SELECT rec AS record, round(sum(value * 0.0001 - 0.1) FILTER (value <> -9999), 6) AS reflectance FROM pix GROUP BY rec")
def nm32_scale_offset(spark, d):
    p = tiles.pixels_of_tiles(_tiles(spark, d).join(_records(spark, d), "record"))
    return p.groupBy("record").agg(F.round(F.sum(F.when(F.col("value") != F.col("nodata"), F.col("value") * 0.0001 - 0.1)), 6).alias("reflectance"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
