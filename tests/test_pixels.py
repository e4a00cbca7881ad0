import itertools
import random

import numpy as np
import pytest

from scenegrain.functions import crs, wkb
from scenegrain.operators import area, points as pts, raster_read as R, tiles as TL
from scenegrain.sources.bytes import LocalBytes, Retrying
from scenegrain.tiff import decode, header, write

RECORDS = "record long, seq long, datetime timestamp_ntz, bbox struct<xmin: double, ymin: double, xmax: double, ymax: double>, sx double, tx double, sy double, ty double, width int, height int, tile_w int, tile_h int, nodata double"


def raster(spark, arrays, transform=(1.0, 0.0, -1.0, 10.0), nodata=-9999.0, tile=5):
    recs, tls = [], []
    for k, (a, shift) in enumerate(arrays):
        h, w = a.shape
        sx, tx, sy, ty = transform
        tx += shift
        recs.append((k, k, None, (tx, ty + h * sy, tx + w * sx, ty), sx, tx, sy, ty, w, h, tile, tile, nodata))
        for r, c in itertools.product(range(-(-h // tile)), range(-(-w // tile))):
            t = np.zeros((tile, tile))
            part = a[r * tile : (r + 1) * tile, c * tile : (c + 1) * tile]
            t[: part.shape[0], : part.shape[1]] = part
            tls.append((k, r, c, [float(v) for v in t.ravel()]))
    return spark.createDataFrame(recs, RECORDS), spark.createDataFrame(tls, "record long, tile_row int, tile_col int, pixels array<double>")


def point(spark, x, y, i=7):
    return spark.createDataFrame([(i, float(x), float(y))], "point_index long, x double, y double")


def test_golden_points(spark):
    r, t = raster(spark, [(np.full((10, 10), 123.0), 0)], transform=(0.1, 0.0, -0.1, 1.0))
    assert [(x.point_index, x.value) for x in pts.sample(point(spark, 0.5, 0.5), r, t).collect()] == [(7, 123.0)]
    a = np.full((10, 10), -9999.0)
    a[5, 4] = 77
    r, t = raster(spark, [(a, 0)])
    s = pts.sample(point(spark, 5.5, 4.5), r, t, max_distance=1, neighbourhood="always").first()
    assert s.value == 77 and s.neighbourhood_values == [-9999.0] * 3 + [77.0] + [-9999.0] * 5
    b = np.full((10, 10), -9999.0)
    b[4, 5], b[5, 6] = 11, 22
    r, t = raster(spark, [(b, 0)])
    assert pts.sample(point(spark, 5.99, 4.01), r, t, max_distance=1).first().value == 22  # nearer in the same ring
    c = np.full((10, 10), -9999.0)
    c[4, 4], c[5, 7] = 1, 2
    r, t = raster(spark, [(c, 0)])
    assert pts.sample(point(spark, 5.99, 4.5), r, t, max_distance=2).first().value == 1  # the smaller ring wins over the nearer pixel
    corner = pts.sample(point(spark, 0.5, 9.5), r, t, max_distance=1, neighbourhood="if_center_nodata").first().neighbourhood_values
    assert np.isnan(corner[0]) and corner[4] == -9999.0
    assert pts.sample(point(spark, 50.0, 50.0), r, t).count() == 0
    with pytest.raises(ValueError):
        pts.sample(point(spark, 1, 1), r, t, match="best")
    with pytest.raises(ValueError):
        pts.sample(point(spark, 1, 1), r, t, neighbourhood="always")


def test_mosaic(spark):
    first, second = np.array([[1.0, 1, 0, 0]] * 4), np.full((4, 4), 2.0)
    r, t = raster(spark, [(first, 0), (second, 0)], transform=(1.0, 0.0, -1.0, 4.0), nodata=0.0, tile=4)
    m = {(x.gx, x.gy): x.value for x in area.first_valid(area.map_pixels(r, t), ["record"]).collect()}
    assert [[m[c, row] for c in range(4)] for row in range(4)] == [[1, 1, 2, 2]] * 4
    with pytest.raises(Exception, match="records disagree"):
        area.merge_strict(area.map_pixels(r, t)).collect()
    assert {x.value for x in area.merge_strict(area.map_pixels(r.filter("record = 1"), t)).collect()} == {2.0}




def test_ring_and_square_offsets():
    assert TL.ring_offsets(1) == [(-1, -1), (-1, 0), (-1, 1), (1, -1), (1, 0), (1, 1), (0, -1), (0, 1)] and TL.ring_offsets(0) == []
    assert len(TL.ring_offsets(3)) == 24 and len(set(TL.ring_offsets(3))) == 24 and TL.square_offsets(1)[3] == (0, -1)


def test_merge_ranges_equals_sequential(spark):
    rng = random.Random(3)
    rows = [(k, a, a + rng.randrange(1, 3000)) for k in range(3) for a in (rng.randrange(0, 200_000) for _ in range(60))]
    df = spark.createDataFrame(rows, "k int, lo long, hi long")
    got = {}
    for r in TL.merged(df, ["k"], "lo", "hi").collect():
        got.setdefault(r.k, []).append((r.lo, r.hi))
    assert {k: sorted(v) for k, v in got.items()} == {k: R.merge([(a, b) for q, a, b in rows if q == k]) for k in range(3)}


@pytest.mark.parametrize("dtype,compression,predictor,order,big,planar,bands", [
    ("int8", 5, 2, "<", False, 1, 1), ("uint8", 1, 1, "<", False, 1, 3), ("uint16", 8, 2, "<", False, 1, 1), ("int16", 50000, 1, "<", False, 1, 1), ("float32", 8, 3, "<", False, 1, 1),
    ("float16", 8, 3, "<", False, 1, 1), ("float16", 8, 2, "<", False, 1, 1), ("uint16", 34925, 1, "<", True, 1, 1), ("int32", 5, 2, ">", True, 1, 2), ("uint8", 32773, 1, ">", False, 2, 2), ("float64", 32946, 3, ">", False, 2, 3),
])
def test_tiff_round_trip(tmp_path, dtype, compression, predictor, order, big, planar, bands):
    rng = np.random.default_rng(1)
    a = (rng.normal(size=(37, 45, bands)) * 40).astype(dtype) if dtype[0] != "u" else rng.integers(0, 250, (37, 45, bands)).astype(dtype)
    at = str(tmp_path / "x.tif")
    write.write(at, a, compression=compression, predictor=predictor, order=order, big=big, planar=planar, transform=(0.5, 10, -0.5, 20))
    s = LocalBytes()
    h = header.parse(lambda o, n: s.get_range(at, o, n))
    assert (h.width, h.height, h.dtype, h.transform, h.epsg) == (45, 37, dtype, (0.5, 10.0, -0.5, 20.0), 4326)
    for b in range(bands):
        assert (R.read_area(s, at, h, b, None, mode="full")["data"] == a[:, :, b]).all()


def test_tiff_headers(tmp_path, spark):
    s, a = LocalBytes(), np.arange(64, dtype="int16").reshape(8, 8)
    def head(**kw):
        write.write(str(tmp_path / "h.tif"), a, tile=16, **kw)
        return header.parse(lambda o, n: s.get_range(str(tmp_path / "h.tif"), o, n))
    assert head(point=True, transform=(2, 10, -2, 20)).transform == (2, 10, -2, 20)  # written by pixel centres, read by corners
    assert head(transform=(1, 0, 1, 5)).transform == (1, 0, 1, 5) and head(model_transform=True).transform == (1, 0, -1, 0)
    assert head(nodata="nan").nodata != head(nodata="nan").nodata and head(nodata=-128).nodata == -128 and head().nodata is None
    assert head(metadata='<GDALMetadata><Item name="NODATA_VALUES">7 8</Item></GDALMetadata>').nodata == 7 and head(metadata="<broken").nodata is None
    assert head(epsg=32632).epsg == 32632
    for bad in ({"tiled": False}, {"compression": 7}):
        with pytest.raises(NotImplementedError):
            head(**bad)
    with pytest.raises(NotImplementedError):
        decode.decompress(b"", decode.LERC)
    (tmp_path / "junk.tif").write_bytes(b"not a tiff at all")
    urls = spark.createDataFrame([(str(tmp_path / "h2.tif"),), (str(tmp_path / "junk.tif"),), (str(tmp_path / "gone.tif"),)], "href string")
    write.write(str(tmp_path / "h2.tif"), a, tile=16)
    rows = {r.href.split("/")[-1]: r for r in header.parse_headers(urls).collect()}
    assert rows["h2.tif"].header.image_width == 8 and rows["h2.tif"].error is None and rows["junk.tif"].header is None and rows["gone.tif"].error.startswith("FileNotFoundError")


def test_area_reads(tmp_path, spark):
    a = np.arange(400, dtype="int16").reshape(20, 20)
    at = str(tmp_path / "a.tif")
    write.write(at, a, tile=16, compression=8, predictor=2, transform=(1, 0, -1, 20), nodata=21)
    s = LocalBytes()
    h = header.parse(lambda o, n: s.get_range(at, o, n))
    sq = lambda x0, y0, x1, y1: wkb.parse(wkb.polygon([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]))
    got = R.read_area(s, at, h, None, sq(0.2, 17.2, 2.8, 19.8))
    assert got["data"].shape == (3, 3) and (got["data"] == a[:3, :3]).all() and got["valid"].sum() == 8 and got["transform"] == (1, 0, -1, 20)
    out = R.read_area(s, at, h, None, sq(-2, 18, 2, 22), mode="window", fill=-5)
    assert out["data"].shape == (4, 4) and (out["data"][:2] == -5).all() and (out["data"][2:, 2:] == a[:2, :2]).all()
    assert R.read_area(s, at, h, None, sq(50, 50, 51, 51)) is None
    tri = wkb.parse(wkb.polygon([(0, 20), (4, 20), (0, 16), (0, 20)]))
    centre, touched = (R.polygon_mask(tri, h.transform, 0, 0, (4, 4), t).sum() for t in (False, True))
    assert centre < touched
    x, y = crs.transform([0, 2, 2, 0, 0], [18, 18, 20, 20, 18], 4326, 3857)
    req = spark.createDataFrame([("r", 1, "B1", at, None, wkb.polygon(list(zip(x, y))), 3857), ("bad", 1, "B1", "/no/file.tif", None, wkb.polygon([(0, 0), (1, 0), (1, 1), (0, 0)]), 4326), ("odd", 2, "B1", at, None, wkb.point(1, 1), 4326)], "record string, geometry_id long, band string, href string, band_index int, geometry binary, geometry_epsg int")
    rows = {r.record: r for r in R.read_frame(req, partitions=2).collect()}
    assert (np.frombuffer(rows["r"].data, rows["r"].dtype).reshape(rows["r"].height, rows["r"].width)[:2, :2] == a[:2, :2]).all()
    assert "FileNotFoundError" in rows["bad"].error and "unsupported geometry" in rows["odd"].error
    with pytest.warns(UserWarning):
        assert R.to_numpy(R.read_frame(req, partitions=2), ["B1"]).shape[0] == 1
    with pytest.raises(RuntimeError):
        R.to_numpy(R.read_frame(req.filter("record = 'bad'"), partitions=1), ["B1"])


def test_reproject_shapes_and_dtypes():
    a = np.arange(100, dtype="int16").reshape(10, 10)
    same, t = R.reproject(a, (1.0, 0.0, -1.0, 10.0), 4326, 4326, grid=((1.0, 0.0, -1.0, 10.0), 10, 10))
    assert same.dtype == np.float32 and (same == a).all()
    out, _ = R.reproject(a, (0.001, 9.0, -0.001, 0.005), 4326, 32632)
    assert np.isfinite(out).any() and out.shape[0] > 5
    m = np.array([[1, 1, 0], [0, 0, 0], [0, 1, 1]], bool)
    assert R.shapes(m) == [(2, 0, 0, 0, 1), (2, 2, 1, 2, 2)]
    assert R.tensor_ready(np.zeros(2, "uint16")).dtype == np.int32 and R.tensor_ready(np.zeros(2, "uint8")).dtype == np.uint8


def test_retrying_source(tmp_path):
    (tmp_path / "f").write_bytes(b"0123456789")

    class Flaky(LocalBytes):
        left = 2

        def get_ranges(self, url, ranges):
            self.left -= 1
            return [b""] * len(ranges) if self.left >= 0 else super().get_ranges(url, ranges)

    assert Retrying(Flaky(), wait=0).get_range(str(tmp_path / "f"), 2, 3) == b"234"
    with pytest.raises(OSError):
        Retrying(LocalBytes(), wait=0).get_range(str(tmp_path / "f"), 8, 5)


def test_contract_columns_and_collisions(spark):
    r, t = raster(spark, [(np.ones((10, 10)), 0)])
    s = pts.sample(point(spark, 5.5, 4.5).selectExpr("*", "'p' as plot"), r, t)
    row = pts.to_contract(s, "B1", metadata=["plot"])
    assert row.columns == ["point_index", "point_x", "point_y", "point_crs", "record_id", "datetime", "collection", "band", "value", "raster_crs", "plot"]
    with pytest.raises(ValueError):
        pts.to_contract(s, "B1", metadata=["value"])
    assert pts.to_contract(s.limit(0), "B1", metadata=["plot"]).columns[-1] == "plot"
