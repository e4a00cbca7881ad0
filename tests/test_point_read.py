"""Points of files: against brute force, over several systems, from stored headers, and where much is asked of few files."""

import random
from datetime import datetime

import numpy as np
import pytest

from scenegrain.collection import Collection
from scenegrain.functions import crs, geometry
from scenegrain.ingest import enrich
from scenegrain.operators import point_read
from scenegrain.sources.bytes import LocalBytes
from scenegrain.tiff import header, write
from tests.test_read import SCHEMA, pts


def brute(a, nodata, rf, cf, reach):
    """(value, window) of a point: the nearest valid pixel of the smallest ring that has one, then the first in order."""
    row, col = int(np.floor(rf)), int(np.floor(cf))
    ok = lambda r, c: 0 <= r < a.shape[0] and 0 <= c < a.shape[1]
    window = [float(a[row + i, col + j]) if ok(row + i, col + j) else np.nan for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
    value = float(a[row, col])
    for radius in range(1, reach + 1):
        if value != nodata:
            break
        best = None
        for i, j in point_read.ring_offsets(radius):
            r, c = row + i, col + j
            if ok(r, c) and a[r, c] != nodata:
                d = max(r - rf, rf - r - 1, 0) ** 2 + max(c - cf, cf - c - 1, 0) ** 2
                if best is None or d < best[0]:
                    best = (d, float(a[r, c]))
        if best:
            value = best[1]
    return value, window


@pytest.mark.parametrize("reach", [0, 1, 5, 20])
def test_sample_equals_brute_force_across_tile_borders(tmp_path, reach):
    rng = np.random.default_rng(reach)
    a = rng.integers(0, 50, (75, 53)).astype("int16")
    a[rng.random(a.shape) < 0.7] = -1
    a[20:50, 10:40] = -1  # a hole wider than a tile
    f = str(tmp_path / "a.tif")
    write.write(f, a, tile=16, transform=(0.5, 100, -0.5, 60), nodata=-1)
    s = LocalBytes()
    h = header.parse(lambda at, n: s.get_range(f, at, n))
    rf, cf = rng.uniform(-2, 77, 400), rng.uniform(-2, 55, 400)
    got = point_read.sample(s, f, h, 0, 100 + cf * 0.5, 60 - rf * 0.5, reach, "always" if reach else "off")
    for i in range(400):
        inside = 0 <= rf[i] < 75 and 0 <= cf[i] < 53
        assert got.hit[i] == inside
        if inside:
            value, window = brute(a, -1, rf[i], cf[i], reach)
            assert got.value[i] == value and (not reach or np.array_equal(got.window[i], window, equal_nan=True))


def raster(spark, path, a, day, box, **kw):
    write.write(path, a, tile=16, **kw)
    return (path.split("/")[-1], datetime(2024, 1, day), None, {"red": (path, 0)}, box)


def test_latest_has_one_winner_over_all_systems(spark, tmp_path):
    x, y = crs.transform([10.0, 12.0], [48.0, 50.0], 4326, 3857)
    merc = (float(x[1] - x[0]) / 20, float(x[0]), -float(y[1] - y[0]) / 20, float(y[1]))
    rows = [
        raster(spark, str(tmp_path / "old"), np.full((20, 20), 1, "int16"), 1, (10.0, 48.0, 12.0, 50.0), transform=(0.1, 10, -0.1, 50)),
        raster(spark, str(tmp_path / "new"), np.full((20, 20), 2, "int16"), 9, (10.0, 48.0, 12.0, 50.0), transform=merc, epsg=3857),
        raster(spark, str(tmp_path / "mid"), np.full((20, 20), 3, "int16"), 5, None, transform=(0.1, 11, -0.1, 50)),  # no box: that of the header
    ]
    c, p = Collection(spark.createDataFrame(rows, SCHEMA)), pts(spark, [("a", 11.05, 49.05), ("b", 12.55, 49.05)])
    got = {(r.name, r.record_id): (r.value, r.raster_crs) for r in c.sample_points(p, ["red"], match="latest").collect()}
    assert got == {("a", "new"): (2.0, 3857), ("b", "mid"): (3.0, 4326)}
    assert {(r.name, r.record_id) for r in c.sample_points(p, ["red"]).collect()} == {("a", "old"), ("a", "new"), ("a", "mid"), ("b", "mid")}


def no_headers():
    class NoHeaders(LocalBytes):  # local, so that workers get it by value
        def get_range(self, url, offset, size):
            raise AssertionError("a header was read")

    return NoHeaders()


def test_stored_headers_are_not_read_again(spark, tmp_path):
    rows = [raster(spark, str(tmp_path / f"{k}"), np.full((20, 20), k, "int16"), 1, (10.0 + k, 48.0, 12.0 + k, 50.0), transform=(0.1, 10 + k, -0.1, 50), nodata=-1) for k in range(3)]
    c = Collection(enrich.enrich(spark.createDataFrame(rows, SCHEMA), ["red"]))
    got = {(r.record_id, r.value) for r in c.sample_points(pts(spark, [("a", 11.05, 49.05)]), ["red"], source=no_headers()).collect()}
    assert got == {("0", 0.0), ("1", 1.0)}
    aoi = spark.createDataFrame([(1, geometry.box(11.0, 49.0, 11.5, 49.5))], "geometry_id long, geometry binary")
    assert c.area_frame(aoi, ["red"], source=no_headers()).filter("error IS NULL").count() == 2
    # and of files whose headers aren't held only those that a point lies in are opened
    with pytest.raises(RuntimeError, match="a header was read"):
        Collection(spark.createDataFrame(rows, SCHEMA)).sample_points(pts(spark, [("a", 10.05, 49.05)]), ["red"], source=no_headers())
    assert Collection(spark.createDataFrame(rows, SCHEMA)).sample_points(pts(spark, [("a", 60.0, 9.0)]), ["red"], source=no_headers()).count() == 0


def test_many_points_of_one_file_are_cut_into_parts(spark, tmp_path):
    rng = random.Random(1)
    a = np.arange(6400, dtype="int32").reshape(80, 80)
    rows = [raster(spark, str(tmp_path / "hot"), a, 1, (10.0, 42.0, 18.0, 50.0), transform=(0.1, 10, -0.1, 50))]
    spots = [(str(i), rng.uniform(10, 18), rng.uniform(42, 50)) for i in range(900)] + [("same", 10.05, 49.95)] * 60
    c = Collection(spark.createDataFrame(rows, SCHEMA))
    got = c.sample_points(pts(spark, spots), ["red"], points_at_once=100).select("point_x", "point_y", "value").collect()
    assert len(got) == 960 and all(r.value == a[int((50 - r.point_y) / 0.1), int((r.point_x - 10) / 0.1)] for r in got)


def test_points_and_records_without_a_place(spark, tmp_path):
    rows = [raster(spark, str(tmp_path / "r"), np.full((20, 20), 4, "int16"), 1, (10.0, 48.0, 12.0, 50.0), transform=(0.1, 10, -0.1, 50)), ("none", None, None, {}, (10.0, 48.0, 12.0, 50.0)), ("lost", None, None, {"red": (str(tmp_path / "lost"), 0)}, None)]
    c = Collection(spark.createDataFrame(rows, SCHEMA))
    p = spark.createDataFrame([("a", 11.05, 49.05), ("b", None, 49.0), ("c", float("nan"), 49.0), ("d", 1e9, -1e9)], "name string, lon double, lat double")
    with pytest.warns(RuntimeWarning, match="1 files"):
        got = c.sample_points(p, ["red"], errors=True).collect()
    assert {(r.name, r.record_id, r.value, r.error is None) for r in got} == {("a", "r", 4.0, True), (None, "lost", None, False)}
    assert c.sample_points(p, ["absent"]).count() == 0 and Collection(c.df.limit(0)).sample_points(p, ["red"]).count() == 0
