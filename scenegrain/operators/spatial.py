"""Points near other points, and the regions that contain them (problem 2).

Defined cases
  * Points whose WKB is set take it; if it is unreadable or not finite, or both coordinates are missing,
    not finite or out of range, the point has no place and no rows come out.
  * ``point_crs`` null means 4326; a system other than 4326 or 3857 gives the point no place.
  * Points sent again count once a place; a point with two places is near whatever is near either.
  * Regions that are missing, empty, unreadable or not polygonal have no rows. Holes are outside.
  * A point on a region's lower or left border is inside, on its upper or right border outside.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenegrain.functions import polygons, wkb
from scenegrain.operators.joins import salted_join
from scenegrain.session import settled, spread

#: Mean radius of the Earth in metres; radius of the sphere of web Mercator.
EARTH_M, MERCATOR_M = 6371008.8, 6378137.0


@F.pandas_udf(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
def wkb_xy(col):
    import pandas as pd

    xy = [wkb.parse_point(b) or (None, None) for b in col]
    return pd.DataFrame(xy, columns=["x", "y"], dtype="float64")


def placed_points(points: DataFrame, index: str = "point_index") -> DataFrame:
    """Distinct (index, lon, lat) of the points that have a place."""
    r = MERCATOR_M
    x, y, crs = F.col("point_x"), F.col("point_y"), F.coalesce("point_crs", F.lit(4326))
    flat = points.filter("geometry IS NULL").select(
        index,
        F.when(crs == 4326, x).when(crs == 3857, F.degrees(x / r)).alias("lon"),
        F.when(crs == 4326, y).when(crs == 3857, F.degrees(F.atan(F.sinh(y / r)))).alias("lat"),
    )
    packed = points.filter("geometry IS NOT NULL").select(index, wkb_xy("geometry").alias("g")).select(index, F.col("g.x").alias("lon"), F.col("g.y").alias("lat"))
    ok = lambda c, most: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) <= most)
    return flat.unionByName(packed).filter(F.col(index).isNotNull() & ok("lon", 180) & ok("lat", 90)).distinct()


def distance_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance by haversines."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def near_pairs(placed: DataFrame, metres: float, index: str = "point_index") -> DataFrame:
    """Distinct (left_id, right_id, metres) of different points at most ``metres`` apart, smaller index first.

    Bands of latitude as high as the distance; in each band as many bins of longitude as are at least as
    wide as the distance. A point looks into its own band and the one above, so each pair meets once.
    """
    high = math.degrees(metres / EARTH_M) * 1.0001
    band = lambda lat: F.floor((lat + 90) / high).cast("long")

    def wide(b: Column) -> Column:  # degrees of longitude that the distance can span in the band or its neighbours
        top = F.least(F.greatest(F.abs((b - 1) * high - 90), F.abs((b + 2) * high - 90)), F.lit(90.0))
        s = F.lit(math.sin(metres / EARTH_M / 2) * 1.0001) / F.greatest(F.cos(F.radians(top)), F.lit(1e-12))
        return F.when(s >= 1, F.lit(360.0)).otherwise(F.degrees(2 * F.asin(F.least(s, F.lit(1.0)))))

    def bins(b: Column) -> Column:
        return F.greatest(F.floor(360 / wide(b)), F.lit(1)).cast("long")

    home = placed.select(F.col(index).alias("right_id"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), band(F.col("lat")).alias("band"))
    home = home.withColumn("bin", F.pmod(F.floor((F.col("lon2") + 180) / 360 * bins(F.col("band"))).cast("long"), bins(F.col("band"))))
    probe = placed.select(F.col(index).alias("left_id"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), band(F.col("lat")).alias("own"))
    probe = probe.withColumn("d", wide(F.col("own"))).withColumn("band", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    n = bins(F.col("band"))
    at = lambda lon: F.floor((lon + 180) / 360 * n).cast("long")
    first, last = at(F.col("lon1") - F.col("d")), at(F.col("lon1") + F.col("d"))
    probe = probe.withColumn("bin", F.explode(F.array_distinct(F.transform(F.sequence(first, F.least(last, first + n - 1)), lambda k: F.pmod(k, n))))).drop("d")
    j = salted_join(probe, home, ["band", "bin"], heavy=True)
    far = distance_m(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2"))
    j = j.filter((F.col("left_id") != F.col("right_id")) & ((F.col("own") != F.col("band")) | (F.col("left_id") < F.col("right_id")))).withColumn("metres", far).filter(F.col("metres") <= metres)
    return j.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "metres").groupBy("left_id", "right_id").agg(F.min("metres").alias("metres"))


def footprints(records: DataFrame, id_col: str, geometry: str = "geometry") -> tuple[DataFrame, DataFrame]:
    """Distinct (id, region) of the readable footprints, and one (region, geometry) a region.

    ``region`` is equal for geometries written in different but equal ways. Each distinct text is parsed once.
    """
    src = records.select(F.col(id_col).alias("id"), F.col(geometry).alias("geometry")).filter("id IS NOT NULL AND geometry IS NOT NULL").withColumn("text", F.md5("geometry"))

    def run(batches):
        for b in batches:
            parsed = [wkb.parse(g) for g in b.column(1).to_pylist()]
            ok = pa.array([p is not None for p in parsed], pa.bool_())
            keys = pa.array([polygons.key(p) for p in parsed if p is not None], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), keys, b.column(1).filter(ok)], names=["text", "region", "geometry"])

    texts = src.groupBy("text").agg(F.first("geometry").alias("geometry"))
    texts = spread(texts, "text").mapInArrow(run, "text string, region long, geometry binary")
    texts = settled(records.sparkSession, texts, "footprints")  # parsed once, read twice
    ids = src.select("id", "text").distinct()
    return salted_join(ids, texts.select("text", "region"), ["text"]).select("id", "region").distinct(), texts.groupBy("region").agg(F.min("geometry").alias("geometry"))


def slab_table(regs: DataFrame, cell: float = 0.25, across: int = 16) -> DataFrame:
    """Rows (level, cx, cy, region, slabs): the trapezoidal decomposition of each region, spread over a grid of side ``cell`` x 2^level.

    The level is the least at which the region is at most ``across`` cells wide and high, so even one that spans the Earth is a few hundred rows.
    """

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], []]

            def held(out=out):
                arrays = [pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                return pa.RecordBatch.from_arrays(arrays, names=["level", "cx", "cy", "region", "slabs"])

            for key, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p = wkb.parse(g)
                x0, y0, x1, y1 = wkb.bounds(p)
                level = max(0, polygons.level_of(max(x1 - x0, y1 - y0) / (across * cell)))
                for cx, cy, packed in polygons.slabs(p, cell * 2**level):
                    for col, v in zip(out, (level, cx, cy, key, packed)):
                        col.append(v)
                if len(out[0]) >= 8192:
                    yield held()
                    for c in out:
                        c.clear()
            yield held()

    return spread(regs.select("region", "geometry"), "region").mapInArrow(run, "level int, cx long, cy long, region long, slabs binary")


def locate_points(placed: DataFrame, table: DataFrame, cell: float = 0.25, index: str = "point_index", points_at_once: int = 50_000, slabs_at_once: int = 4_000) -> DataFrame:
    """Distinct (point index, region) of the regions of a ``slab_table`` that contain the point.

    Points and slabs meet in buckets of cells, each slab once a bucket. A cell with more of either than a task should
    hold is cut: its points by a salt, its slabs into parts, and each part meets each salt.
    """
    kind = placed.schema[index].dataType.simpleString()
    levels = sorted(r.level for r in table.select("level").distinct().collect())  # a few, however many regions there are
    side = F.lit(cell) * F.pow(F.lit(2.0), F.col("level"))
    p = placed.select(F.col(index).alias("p"), "lon", "lat", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("level"))
    p = p.select("p", "lon", "lat", "level", F.floor(F.col("lon") / side).cast("long").alias("cx"), F.floor(F.col("lat") / side).cast("long").alias("cy"))
    place = ["level", "cx", "cy"]
    n = p.groupBy(*place).agg(F.count("*").alias("np_"))
    m = table.groupBy(*place).agg(F.count("*").alias("ns_"))
    both = n.join(m, place).select(*place, F.ceil(F.col("np_") / points_at_once).cast("int").alias("salts_"), F.ceil(F.col("ns_") / slabs_at_once).cast("int").alias("parts_"), "np_", "ns_")
    both = settled(placed.sparkSession, both, "cells")  # one row a cell with both
    sums = both.agg(F.sum("np_"), F.sum("ns_")).first()
    spark = placed.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, int((sums[0] or 0) // points_at_once), int((sums[1] or 0) // slabs_at_once))
    keys = [*place, "salt_", "part_"]
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("b")
    cut = both.select(*place, "salts_", "parts_")
    l = p.join(cut, place).withColumn("salt_", F.pmod(F.xxhash64("p"), "salts_").cast("int")).withColumn("part_", F.explode(F.sequence(F.lit(0), F.col("parts_") - 1)))
    r = table.join(cut, place).withColumn("part_", F.pmod(F.xxhash64("region"), "parts_").cast("int")).withColumn("salt_", F.explode(F.sequence(F.lit(0), F.col("salts_") - 1)))

    def meet(a: pa.Table, t: pa.Table) -> pa.Table:
        points, regs = [], []
        if a.num_rows and t.num_rows:
            codes = [np.stack([x.column(k).to_numpy().astype("i8") for k in keys], axis=1) for x in (a, t)]
            both_, code = np.unique(np.concatenate(codes), axis=0, return_inverse=True)
            mine, theirs = code[: a.num_rows], code[a.num_rows :]
            order = np.argsort(mine, kind="stable")
            start = np.searchsorted(mine[order], np.arange(len(both_) + 1))
            ids, x, y = a.column("p").to_numpy(), a.column("lon").to_numpy(), a.column("lat").to_numpy()
            for c, reg, packed in zip(theirs.tolist(), t.column("region").to_pylist(), t.column("slabs").to_pylist()):
                at = order[start[c] : start[c + 1]]
                if len(at):
                    hit = at[polygons.locate(packed, x[at], y[at])]
                    points.append(ids[hit]), regs.append(np.full(len(hit), reg))
        cat = lambda v: np.concatenate(v).astype("i8") if v else np.empty(0, "i8")
        return pa.table({"point": pa.array(cat(points)).cast(pa.int32() if kind == "int" else pa.int64()), "region": pa.array(cat(regs))})

    met = l.select(bucket, "p", "lon", "lat", *keys).repartition(buckets, "b").groupBy("b").cogroup(r.select(bucket, "region", "slabs", *keys).repartition(buckets, "b").groupBy("b")).applyInArrow(meet, f"point {'int' if kind == 'int' else 'bigint'}, region long")
    return met.distinct()


def points_in_records(points: DataFrame, records: DataFrame, id_col: str = "fid", cell: float = 0.25, placed: DataFrame | None = None) -> DataFrame:
    """Distinct (point, id): each point and the records whose footprint contains it.

    Records written over the same ground share one region, so each point is located once a region and
    not once a record.
    """
    spark = records.sparkSession
    prints, regs = footprints(records, id_col)
    table = settled(spark, slab_table(regs, cell), "slabs")  # read twice: for the counts and for the rows
    hits = locate_points(placed_points(points) if placed is None else placed, table, cell)
    return salted_join(prints, hits, ["region"]).select("point", "id")


def neighbours(points: DataFrame, records: DataFrame, metres: float = 250.0) -> DataFrame:
    """Rows (kind, left_id, right_id): ``near`` pairs of points and points ``inside`` records."""
    placed = settled(points.sparkSession, placed_points(points), "placed")  # read several times
    near = near_pairs(placed, metres).select(F.lit("near").alias("kind"), "left_id", "right_id")
    inside = points_in_records(points, records, placed=placed).select(F.lit("inside").alias("kind"), F.col("point").alias("left_id"), F.col("id").alias("right_id"))
    return near.unionByName(inside)
