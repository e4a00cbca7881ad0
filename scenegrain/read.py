"""Reading pixels of a collection: points, areas, arrays and long pixel tables, from the files its assets name."""

from __future__ import annotations

import json
import warnings
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenegrain.collection import Collection
from scenegrain.functions import crs, geometry
from scenegrain.ingest.enrich import resolve_bands
from scenegrain.operators import points as pts
from scenegrain.operators import point_read, raster_read
from scenegrain.operators.range_join import overlap_join
from scenegrain.session import settled, spread
from scenegrain.sources.bytes import ByteSource, default_source
from scenegrain.tiff.header import STRUCT, Header, parse_headers

RESERVED = ("point_index", "point_x", "point_y", "point_crs", "record_id", "datetime", "collection", "band", "value", "raster_crs", "neighbourhood_values")
_STRUCT = f"struct<{', '.join(x.replace(' ', ': ', 1) for x in STRUCT.split(', ') )}>"


def band_files(c: Collection, bands: Sequence[str], band_map: dict[str, str] | None = None) -> DataFrame:
    """Rows (record, seq, band, href, band_index, head, datetime, collection, bbox): the files of the bands, with the header (JSON) that the collection holds for them, else null."""
    r = c.rows().withColumn("seq", F.xxhash64("id"))
    if "collection" not in r.columns:
        r = r.withColumn("collection", F.lit(c.data_source))
    keep = ["record", "seq", "datetime", "collection", "bbox", "assets"]
    band_map = band_map or {}
    back = {v: k for k, v in band_map.items()}
    stored = {}
    for b in bands:
        cols = [f"{k}_metadata" for k in dict.fromkeys([b, band_map.get(b), back.get(b)]) if k and f"{k}_metadata" in r.columns]
        if cols:
            stored[b] = F.coalesce(*[F.to_json(F.col(f"`{k}`")) for k in cols])
    heads = F.create_map(*[x for b, j in stored.items() for x in (F.lit(b), j)]) if stored else F.lit(None).cast("map<string,string>")
    r = r.select(F.col("id").alias("record"), *keep[1:], heads.alias("heads"))
    return resolve_bands(r, bands, band_map).withColumn("head", F.col("heads")[F.col("band")]).drop("assets", "heads")


def with_heads(files: DataFrame, source: ByteSource | None = None) -> DataFrame:
    """Distinct (href, head, error) of rows with ``href`` and ``head``: only headers that the collection lacks are parsed, each once."""
    each = files.groupBy("href").agg(F.first("head", ignorenulls=True).alias("head"))
    lack = spread(each.filter("head IS NULL").select("href"), "href")
    parsed = parse_headers(lack, source=source).select("href", F.to_json("header").alias("head"), "error")
    return settled(files.sparkSession, each.filter("head IS NOT NULL").withColumn("error", F.lit(None).cast("string")).unionByName(parsed), "headers")


def sources(c: Collection, bands: Sequence[str], band_map: dict[str, str] | None = None, source: ByteSource | None = None) -> DataFrame:
    """Rows (record, seq, band, href, band_index, header, error, datetime, collection, bbox): the files of the bands with their headers."""
    b = band_files(c, bands, band_map)
    return b.drop("head").join(with_heads(b, source).withColumn("header", F.from_json("head", _STRUCT)).drop("head"), "href")


def prepare_points(points: DataFrame, x_column: str | None = None, y_column: str | None = None, index: str | None = None) -> DataFrame:
    """(point_index, x, y) and the caller's other columns; points without an ``index`` column are numbered from 0 in order of all their columns."""
    from scenegrain.operators.ids import numbered

    x, y = geometry.xy_columns(points.columns, x_column, y_column)
    own = [c for c in points.columns if c not in (x, y, index)]
    geometry.fail_on_collisions(own, [c for c in RESERVED if c != "point_index"])
    p = points if index else numbered(points, points.columns, "point_index")
    return p.select(F.col(index or "point_index").cast("long").alias("point_index"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *own)


def _own_boxes(files: DataFrame, heads: DataFrame) -> DataFrame:
    """The files with the lon/lat box of their header in ``bbox``; none where there is no header or its system isn't known."""

    def run(batches):
        for b in batches:
            boxes = []
            for head in b.column(1).to_pylist():
                try:
                    h = Header.of(json.loads(head))
                    sx, tx, sy, ty = h.transform
                    x, y = sorted((tx, tx + sx * h.width)), sorted((ty, ty + sy * h.height))
                    boxes.append(dict(zip(("xmin", "ymin", "xmax", "ymax"), crs.transform_bbox((x[0], y[0], x[1], y[1]), h.epsg or 4326, 4326))))
                except Exception:
                    boxes.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(boxes, pa.struct([(k, pa.float64()) for k in ("xmin", "ymin", "xmax", "ymax")]))], names=["href", "own"])

    own = heads.select("href", "head").mapInArrow(run, "href string, own struct<xmin: double, ymin: double, xmax: double, ymax: double>")
    return files.join(own, "href", "left").withColumn("bbox", F.col("own")).drop("own")


def sample_points(c: Collection, points: DataFrame, bands: Sequence[str], *, x_column: str | None = None, y_column: str | None = None, index: str | None = None, match: str = "all", max_distance: int = 0, neighbourhood: str = "off", band_map: dict[str, str] | None = None, source: ByteSource | None = None, cell: float = 1.0, errors: bool = False, points_at_once: int = 50_000) -> DataFrame:
    """The sample table of lon/lat points: one row per point, record and band whose tile was read.

    Records are chosen by their lon/lat box before anything is read; those without a box by that of their header. Headers
    that the collection holds (``{band}_metadata``) are taken from it, others parsed once a file, and only of files that were chosen.
    With ``match="latest"`` a point and band have one winner over all records whose header is known, whatever their system: the
    latest (no time is oldest, then scan order); if its raster doesn't hold the point, no other takes its place.
    The points of a file are sampled where its tiles are decoded: only tiles that hold a point, or lie within
    ``max_distance`` of one, are read, and only samples leave the task. ``max_distance`` and ``neighbourhood``: see ``operators.points.sample``.

    Reads that fail are counted in a warning, and raise if no tile could be read. With ``errors`` they are rows too,
    with an ``error`` and no value: of a tile, each of its points; of a file whose header failed or whose system isn't
    supported, each point in its lon/lat box (one row without point where it has no box).
    A sample whose fallback or window lacks a tile that failed has both value and ``error``.
    """
    if match not in pts.MATCHES or neighbourhood not in pts.NEIGHBOURHOODS:
        raise ValueError(f"match is one of {pts.MATCHES}, neighbourhood one of {pts.NEIGHBOURHOODS}")
    if max_distance < 0 or (neighbourhood != "off" and max_distance == 0):
        raise ValueError("max_distance must not be negative, and a neighbourhood needs it above 0")
    p = prepare_points(points, x_column, y_column, index)
    own = [k for k in p.columns if k not in ("point_index", "x", "y")]
    if errors:
        geometry.fail_on_collisions(own, ["error"])
    spark = c.df.sparkSession
    src = source or default_source()
    p = settled(spark, p.select("point_index", F.col("x").alias("x_"), F.col("y").alias("y_"), F.struct(*[F.col(f"`{k}`") for k in own]).alias("own_") if own else F.lit(None).cast("string").alias("own_")), "points")
    b = band_files(c, bands, band_map)
    boxed = F.coalesce(F.col("bbox.xmin") <= F.col("bbox.xmax"), F.lit(False)) & F.coalesce(F.col("bbox.ymin") <= F.col("bbox.ymax"), F.lit(False))
    slim = ["record", "seq", "datetime", "collection", "band", "href", "band_index", "bbox"]
    place = p.select("point_index", "x_", "y_")
    chosen = settled(spark, pts.points_in_boxes(place, b.filter(boxed).select(*slim), "x_", "y_", "bbox", cell).drop("bbox"), "chosen")
    # only chosen files, and those of records without a box, need their headers
    loose = b.filter(~boxed)
    near = b.join(chosen.select("href").distinct(), "href", "left_semi").unionByName(loose)
    heads = with_heads(near.select("href", "head"), src)
    loose = settled(spark, _own_boxes(loose.drop("head"), heads).select(*slim), "loose")
    every = chosen.unionByName(pts.points_in_boxes(place, loose, "x_", "y_", "bbox", cell).drop("bbox")).join(heads.select("href", F.col("head").isNotNull().alias("known_")), "href")
    if match == "latest":
        rest = [k for k in every.columns if k not in ("point_index", "band")]
        best = F.max_by(F.struct(*rest), F.struct(F.coalesce(F.col("datetime"), F.lit("0001-01-01").cast("timestamp_ntz")), -F.col("seq")))
        won = every.filter("known_").groupBy("point_index", "band").agg(best.alias("b_")).select("point_index", "band", "b_.*")
        every = won.unionByName(every.filter("NOT known_"))
    every = settled(spark, every, "pairs")
    # The points of a file are cut by latitude into parts that a task can hold, so that parts share few tiles.
    size = every.groupBy("href").agg(F.count("*").alias("n_"), F.min("y_").alias("lo_"), F.max("y_").alias("hi_")).withColumn("parts_", F.ceil(F.col("n_") / points_at_once).cast("int"))
    size = settled(spark, size, "sizes")
    total = size.agg(F.sum("n_"), F.count("*")).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, int((total[0] or 0) // points_at_once), int((total[1] or 0) // 256))
    spot = F.floor((F.col("y_") - F.col("lo_")) / F.greatest(F.col("hi_") - F.col("lo_"), F.lit(1e-12)) * F.col("parts_")).cast("int")
    asked = every.join(size, "href").withColumn("part_", F.least(F.greatest(spot, F.lit(0)), F.col("parts_") - 1)).drop("n_", "lo_", "hi_", "parts_")
    files = heads.join(size.select("href", "parts_"), "href").withColumn("part_", F.explode(F.sequence(F.lit(0), F.col("parts_") - 1))).drop("parts_")
    bucket = F.pmod(F.xxhash64("href", "part_"), F.lit(buckets)).alias("bucket_")
    shape = "point_index bigint, record string, band string, value double, window array<double>, epsg int, error string, kind int, tiles int, href string"
    kinds = pa.schema([("point_index", pa.int64()), ("record", pa.string()), ("band", pa.string()), ("value", pa.float64()), ("window", pa.list_(pa.float64())), ("epsg", pa.int32()), ("error", pa.string()), ("kind", pa.int32()), ("tiles", pa.int32()), ("href", pa.string())])

    def read(q: pa.Table, f: pa.Table) -> pa.Table:
        """``kind`` 0: a sample or its error; 1: a file that gave no header; 2: tiles read of a file; 3: a tile that failed."""
        out: list[pa.Table] = []
        known = {(r["href"], r["part_"]): r for r in f.to_pylist()}
        if not q.num_rows:
            return kinds.empty_table()
        q = q.sort_by([("href", "ascending"), ("part_", "ascending"), ("record", "ascending"), ("band", "ascending")])
        names = [q.column(k).to_pylist() for k in ("href", "part_", "record", "band", "band_index")]
        keys = list(zip(*names))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        heads_: dict[str, Header | str] = {}
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            href, part, record, band, k = keys[lo]
            part_q = q.slice(lo, hi - lo)
            ids, lon, lat = (part_q.column(x).combine_chunks() for x in ("point_index", "x_", "y_"))
            file = known[href, part]

            def rows(n: int, record=record, band=band, href=href, **cols) -> pa.Table:
                fixed = {"record": record, "band": band, "href": href} | {x: v for x, v in cols.items() if not isinstance(v, (pa.Array, list))}
                return pa.Table.from_arrays([cols[x] if isinstance(cols.get(x), pa.Array) else pa.array(cols[x], kinds.field(x).type) if isinstance(cols.get(x), list) else pa.array([fixed.get(x)] * n, kinds.field(x).type) for x in kinds.names], schema=kinds)

            try:
                if href not in heads_:
                    if file["head"] is None:
                        raise OSError(file["error"] or "no header")
                    heads_ = {href: Header.of(json.loads(file["head"]))}
                h = heads_[href]
                epsg = h.epsg or 4326
                if epsg not in (4326, 3857) and crs.utm_zone(epsg) is None:
                    raise OSError(f"unsupported system EPSG:{epsg}")
                got = point_read.sample(src, href, h, k, lon.to_numpy(), lat.to_numpy(), max_distance, neighbourhood)
            except Exception as e:
                why = str(e) if isinstance(e, OSError) and (file["head"] is None or "unsupported system" in str(e)) else f"{type(e).__name__}: {e}"[:200]
                out.append(rows(hi - lo, point_index=ids, error=why, kind=0))
                out.append(rows(1, error=why, kind=1))
                continue
            at = np.flatnonzero(got.hit | np.array([e is not None for e in got.error]))
            value = pa.array(got.value[at], mask=~got.hit[at])
            out.append(rows(len(at), point_index=ids.take(pa.array(at)), value=value, window=[None if got.window[i] is None else got.window[i].tolist() for i in at], epsg=epsg, error=[got.error[i] for i in at], kind=0))
            out.append(rows(1, kind=2, tiles=got.read))
            for t, why in got.failed.items():
                out.append(rows(1, error=why, kind=3, tiles=t[0] * -(-h.width // h.tile_width) + t[1]))
        return pa.concat_tables(out) if out else kinds.empty_table()

    left = asked.select(bucket, "href", "part_", "record", "band", "band_index", "point_index", "x_", "y_").repartition(buckets, "bucket_")
    right = files.select(bucket, "href", "part_", "head", "error").repartition(buckets, "bucket_")
    sampled = settled(spark, left.groupBy("bucket_").cogroup(right.groupBy("bucket_")).applyInArrow(read, shape), "samples")

    # Of files without a box of any kind that have no header there is one row without a point.
    nowhere = loose.filter("bbox IS NULL").join(heads.select("href", F.coalesce("error", F.lit("no header")).alias("error")), "href", "left")
    tally = sampled.filter("kind > 0").agg(
        F.sum(F.when(F.col("kind") == 2, F.col("tiles"))).alias("read"), F.count_distinct(F.when(F.col("kind") == 1, F.struct("record", "band"))).alias("files"), F.count_distinct(F.when(F.col("kind") == 3, F.struct("href", "record", "band", "tiles"))).alias("tiles"),
        F.min(F.when(F.col("kind") == 1, F.col("error"))).alias("file_error"), F.min(F.when(F.col("kind") == 3, F.col("error"))).alias("tile_error"),
    ).first()
    none = nowhere.agg(F.count("*").alias("n"), F.min("error").alias("error")).first()
    failed = [(n, what, e) for n, what, e in ((tally.tiles, "tiles", tally.tile_error), (tally.files + none.n, "files", tally.file_error or none.error)) if n]
    if failed:
        text = ", ".join(f"{n} {what} (e.g. {e})" for n, what, e in failed)
        if not tally.read:
            raise RuntimeError(f"no point could be read: {text}")
        warnings.warn(f"reads failed for points: {text}", RuntimeWarning, stacklevel=2)
    facts = every.select("point_index", "record", "band", "datetime", "collection").distinct()
    rows = sampled.filter("kind = 0" if errors else "kind = 0 AND value IS NOT NULL").drop("kind", "tiles", "href")
    j = rows.join(facts, ["point_index", "record", "band"]).join(p, "point_index")
    if errors:
        j = j.unionByName(nowhere.select("record", "band", "datetime", "collection", "error"), allowMissingColumns=True)
    cols = [
        F.col("point_index"), F.col("x_").alias("point_x"), F.col("y_").alias("point_y"), F.lit(4326).alias("point_crs"), F.col("record").alias("record_id"), "datetime", F.coalesce("collection", F.lit("")).alias("collection"),
        "band", "value", F.col("epsg").alias("raster_crs"),
    ]
    extra = ["neighbourhood_values"] if neighbourhood != "off" else []
    return j.withColumn("neighbourhood_values", F.col("window")).select(*cols, *extra, *[F.col("own_")[k].alias(k) for k in own], *(["error"] if errors else []))


def area_frame(c: Collection, aois: DataFrame, bands: Sequence[str], *, geometry_epsg: int = 4326, band_map: dict[str, str] | None = None, source: ByteSource | None = None, cell: float = 1.0, **kw) -> DataFrame:
    """One row per (record, geometry_id, band) with the masked window as bytes (``raster_read.FRAME``), and the AOIs' other columns.

    ``aois``: ``geometry_id`` and ``geometry`` (WKB), in ``geometry_epsg``.
    """
    from scenegrain.ingest.normalize import wkb_bbox

    own = [k for k in aois.columns if k not in ("geometry_id", "geometry")]
    geometry.fail_on_collisions(own, [f.split(" ")[0] for f in raster_read.FRAME.split(", ")])
    if geometry_epsg != 4326:
        to = F.arrow_udf(lambda g: pa.array([None if b is None else geometry.transform(b, geometry_epsg, 4326) for b in g.to_pylist()], pa.binary()), "binary")
        boxes = aois.withColumn("aoi", wkb_bbox(to("geometry")))
    else:
        boxes = aois.withColumn("aoi", wkb_bbox("geometry"))
    r = band_files(c, list(bands), band_map).select("record", "bbox", "band", "href", "band_index", "head")
    j = overlap_join(r, boxes.select("geometry_id", "geometry", "aoi"), "bbox", "aoi", cell).withColumn("geometry_epsg", F.lit(geometry_epsg))
    f = raster_read.read_frame(j, source, **kw)
    return f.join(aois.select("geometry_id", *own), "geometry_id", "left") if own else f


def get_numpy(c: Collection, aois: DataFrame, bands: Sequence[str], **kw) -> np.ndarray:
    """[N, H, W] or [N, C, H, W] of a result that fits the driver."""
    return raster_read.to_numpy(area_frame(c, aois, bands, **kw), bands)


def long_pixels(frame: DataFrame, only_valid: bool = True) -> DataFrame:
    """Rows (record, geometry_id, band, y, x, value) at pixel centres: the table behind labelled arrays, for grouping and stacking at any size."""

    def run(batches):
        for b in batches:
            for q in b.to_pylist():
                if q["error"] is not None:
                    continue
                a = np.frombuffer(q["data"], q["dtype"]).reshape(q["height"], q["width"]).astype("f8")
                ok = np.unpackbits(np.frombuffer(q["valid"], "u1"), count=a.size).astype(bool).reshape(a.shape)
                sx, tx, sy, ty = q["transform"]
                i, j = np.nonzero(ok if only_valid else np.ones_like(ok))
                n = len(i)
                yield pa.RecordBatch.from_arrays([pa.array([q["record"]] * n, pa.string()), pa.array([q["geometry_id"]] * n, pa.int64()), pa.array([q["band"]] * n, pa.string()), pa.array(ty + (i + 0.5) * sy), pa.array(tx + (j + 0.5) * sx), pa.array(a[i, j])], names=["record", "geometry_id", "band", "y", "x", "value"])

    return frame.select("record", "geometry_id", "band", "height", "width", "dtype", "data", "valid", "transform", "error").mapInArrow(run, "record string, geometry_id long, band string, y double, x double, value double")

