from datetime import datetime

import numpy as np
import pytest

from scenegrain.collection import Collection
from scenegrain.functions import crs, geometry
from scenegrain.operators import labelled as L
from scenegrain.operators.raster_read import polygon_mask
from scenegrain.tiff import write
from tests.test_read import SCHEMA


@pytest.fixture(scope="module")
def scenes(spark, tmp_path_factory):
    at, rows = tmp_path_factory.mktemp("labelled"), []
    for k, v in ((0, 1), (1, 2), (2, 2)):
        a = np.full((4, 4), v, "int16")
        a[0, 0] = -1
        write.write(str(at / f"{k}.tif"), a, tile=16, transform=(1.0, 10 + 2 * min(k, 1), -1.0, 50), nodata=-1)
        rows.append((f"s{k}", datetime(2024, 1, 9 - k), None, {"red": (str(at / f"{k}.tif"), 0)}, (10.0 + 2 * min(k, 1), 46.0, 14.0 + 2 * min(k, 1), 50.0)))
    return Collection(spark.createDataFrame(rows, SCHEMA))


def test_merges_on_one_grid(spark, scenes):
    aois = spark.createDataFrame([(1, geometry.box(10, 46, 16, 50)), (2, geometry.box(60, 6, 61, 7))], "geometry_id long, geometry binary")
    f = scenes.area_frame(aois, ["red"])
    one = L.labelled(L.on_one_grid(f), ["red"], 4326)
    assert set(one) == {1} and one[1]["data"].shape == (1, 4, 6) and one[1]["attrs"]["GeoTransform"] == "10.0 1.0 0.0 50.0 0.0 -1.0" and one[1]["attrs"]["spatial_ref"] == "EPSG:4326"
    d = one[1]["data"][0]
    assert np.isnan(d[0, 0]) and d[1].tolist() == [1, 1, 1, 1, 2, 2] and d[0, 2] == 1 and one[1]["coords"]["y"].tolist() == [49.5, 48.5, 47.5, 46.5] and one[1]["coords"]["x"][0] == 10.5
    assert L.labelled(L.on_one_grid(f, how="merge_override"), ["red"])[1]["data"][0, 1].tolist() == [1, 1, 2, 2, 2, 2]
    with pytest.raises(RuntimeError, match="disagree"):
        L.labelled(L.on_one_grid(f, how="merge"), ["red"])
    times = scenes.df.selectExpr("id AS record", "datetime")
    # in order of time the last is first
    assert L.labelled(L.on_one_grid(f, times), ["red"])[1]["data"][0, 1].tolist() == [1, 1, 2, 2, 2, 2]
    s = L.labelled(L.on_one_grid(f, times, stack=True), ["red"])[1]
    assert s["data"].shape == (1, 3, 4, 6) and [t.day for t in s["coords"]["time"]] == [7, 8, 9] and np.isnan(s["data"][0, 0, 1, 0]) and s["data"][0, 2, 1, 0] == 1
    with pytest.raises(ValueError):
        L.on_one_grid(f, stack=True)


def test_windows_of_two_systems_fit_on_one_grid(spark, tmp_path):
    x, y = crs.transform([9.0, 9.4], [48.6, 48.9], 4326, 32632)
    rows, step = [], 500.0
    write.write(str(tmp_path / "u.tif"), np.full((60, 50), 7, "uint8"), tile=16, transform=(step, float(x[0]), -step, float(y[1])), epsg=32632)
    write.write(str(tmp_path / "l.tif"), np.full((80, 80), 5, "uint8"), tile=16, transform=(0.005, 9.0, -0.005, 48.9))
    for n in "ul":
        rows.append((n, datetime(2024, 1, 1), None, {"red": (str(tmp_path / f"{n}.tif"), 0)}, (9.0, 48.6, 9.4, 48.9)))
    aoi = spark.createDataFrame([(1, geometry.box(9.05, 48.65, 9.3, 48.85))], "geometry_id long, geometry binary")
    f = Collection(spark.createDataFrame(rows, SCHEMA)).area_frame(aoi, ["red"], to=(3857, 1000.0))
    got = L.labelled(L.on_one_grid(f, how="merge_override"), ["red"], 3857)[1]
    ok = got["data"][0][~np.isnan(got["data"][0])]
    assert set(ok.tolist()) <= {5.0, 7.0} and 7.0 in ok and len(ok) > 0.8 * got["data"][0].size and (got["coords"]["x"] - 500) % 1000 == pytest.approx(0)
    x0, _ = crs.transform([9.05], [48.65], 4326, 3857)
    assert abs(got["coords"]["x"][0] - x0[0]) < 2000


def test_windows_must_fit():
    with pytest.raises(ValueError, match="resolution"):
        L.union_grid([(1, 0, -1, 0), (2, 0, -2, 0)], [(1, 1), (1, 1)])
    with pytest.raises(ValueError, match="grid"):
        L.union_grid([(1, 0, -1, 0), (1, 0.5, -1, 0)], [(1, 1), (1, 1)])
    assert L.union_grid([(1, 5, 1, 5), (1, 3, 1, 7)], [(2, 2), (1, 1)]) == ((1, 3, 1, 5), 3, 4, [(0, 2), (2, 0)])


def test_polygons_cover_the_mask():
    rng = np.random.default_rng(2)
    for density in (0.2, 0.5, 0.8):
        m = rng.random((14, 11)) < density
        got = np.zeros(m.shape, int)
        for rings in L.polygons_of(m, (1.0, 0.0, 1.0, 0.0)):
            assert all(r[0] == r[-1] for r in rings)
            got += polygon_mask([[np.array(r, float) for r in rings]], (1.0, 0.0, 1.0, 0.0), 0, 0, m.shape)
        assert (got == m).all()
    assert L.polygons_of(np.zeros((3, 3), bool)) == []
    (ring,) = L.polygons_of(np.ones((2, 3), bool), (0.5, 10, -0.5, 20))
    assert sorted(ring[0][:-1]) == [(10, 19), (10, 20), (11.5, 19), (11.5, 20)]
