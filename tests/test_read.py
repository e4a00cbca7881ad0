import json
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pytest

from scenegrain import read
from scenegrain.collection import Collection
from scenegrain.functions import crs, geometry as G, wkb
from scenegrain.ingest import enrich
from scenegrain.operators.chips import grid_chips, in_slice, label_value, stride
from scenegrain.operators.ids import numbered
from scenegrain.sources import arrow
from scenegrain.sources.bytes import LocalBytes, Prefixed
from scenegrain.tiff import write

SCHEMA = "id string, datetime timestamp_ntz, geometry binary, assets map<string, struct<href: string, band_index: int>>, bbox struct<xmin: double, ymin: double, xmax: double, ymax: double>"


@pytest.fixture(scope="module")
def scenes(spark, tmp_path_factory):
    """Two overlapping lon/lat rasters, one UTM raster, and one whose file is gone."""
    at, rows = tmp_path_factory.mktemp("scenes"), []
    for k, day in ((0, 1), (1, 9)):
        a = np.arange(400, dtype="int16").reshape(20, 20) + 1000 * k
        a[3, 4] = -9999
        write.write(str(at / f"{k}.tif"), np.dstack([a, a + 5]), tile=16, transform=(0.1, 10 + k, -0.1, 50), nodata=-9999, compression=8)
        rows.append((f"s{k}", datetime(2024, 1, day), None, {"red": (str(at / f"{k}.tif"), 0), "nir": (str(at / f"{k}.tif"), 1)}, (10.0 + k, 48.0, 12.0 + k, 50.0)))
    x, y = crs.transform([9.0], [48.9], 4326, 32632)
    write.write(str(at / "u.tif"), np.full((32, 32), 7, "uint8"), tile=16, transform=(1000, float(x[0]), -1000, float(y[0])), epsg=32632)
    rows.append(("u", datetime(2024, 1, 5), None, {"red": (str(at / "u.tif"), 0)}, (8.9, 48.5, 9.5, 49.0)))
    rows.append(("gone", datetime(2024, 2, 1), None, {"red": (str(at / "none.tif"), 0)}, (10.0, 48.0, 12.0, 50.0)))
    return Collection(spark.createDataFrame(rows, SCHEMA), "scenes", data_source="src")


def pts(spark, rows):
    return spark.createDataFrame([(n, float(x), float(y)) for n, x, y in rows], "name string, lon double, lat double")


def test_sample_points(spark, scenes):
    p = pts(spark, [("a", 11.05, 49.95), ("b", 10.45, 49.65), ("far", 0, 0), ("utm", 9.1, 48.8)])
    got = {(r.name, r.record_id): r for r in scenes.sample_points(p, ["red"]).collect()}
    assert {k: v.value for k, v in got.items()} == {("a", "s0"): 10.0, ("a", "s1"): 1000.0, ("b", "s0"): -9999.0, ("utm", "u"): 7.0}
    assert got["utm", "u"].raster_crs == 32632 and got["a", "s0"].collection == "src" and got["a", "s0"].point_x == 11.05
    near = {r.name: r.value for r in scenes.sample_points(p.filter("name = 'b'"), ["red"], max_distance=1).collect()}
    assert near["b"] != -9999.0
    latest = scenes.sample_points(p.filter("name = 'a'"), ["B08"], match="latest", band_map={"B08": "nir"}).collect()
    assert [(r.record_id, r.value, r.band) for r in latest] == [("s1", 1005.0, "B08")]
    assert scenes.sample_points(p.limit(0), ["red"]).columns[-1] == "name" and scenes.sample_points(p.limit(0), ["red"]).count() == 0
    with pytest.raises(ValueError, match="collide"):
        scenes.sample_points(p.withColumnRenamed("name", "value"), ["red"])


def test_failed_reads_of_points_are_rows_and_raise_if_all_fail(spark, scenes, tmp_path):
    p, gone = pts(spark, [("a", 11.05, 49.95), ("far", 0, 0)]), scenes.df.filter("id = 'gone'")
    with pytest.warns(RuntimeWarning, match="1 files"):
        rows = {(r.name, r.record_id): r for r in scenes.sample_points(p, ["red"], errors=True).collect()}
    assert set(rows) == {("a", "s0"), ("a", "s1"), ("a", "gone")} and rows["a", "s0"].error is None and rows["a", "s0"].value == 10.0
    assert rows["a", "gone"].value is None and rows["a", "gone"].error and rows["a", "gone"].band == "red"
    with pytest.raises(RuntimeError, match="no point could be read"):
        Collection(gone).sample_points(p, ["red"])
    assert Collection(gone).sample_points(p.filter("name = 'far'"), ["red"]).count() == 0
    # one tile of four is cut off: the points of the others stay
    f = tmp_path / "short.tif"
    write.write(str(f), np.arange(400, dtype="int16").reshape(20, 20, 1), tile=16, transform=(0.1, 10, -0.1, 50), nodata=0)
    spots = pts(spark, [("first", 10.05, 49.95), ("border", 11.55, 48.45), ("last", 11.95, 48.05)])
    one = Collection(spark.createDataFrame([("t", datetime(2024, 1, 1), None, {"red": (str(f), 0)}, (10.0, 48.0, 12.0, 50.0))], SCHEMA))
    head = read.sources(one, ["red"]).first().header
    f.write_bytes(f.read_bytes()[: max(head.tile_offsets) + 4])
    with pytest.warns(RuntimeWarning, match="1 tiles"):
        got = {r.name: r for r in one.sample_points(spots, ["red"], max_distance=1, neighbourhood="always", errors=True).collect()}
    assert got["border"].value == 15 * 20 + 15 and "short read" in got["border"].error
    assert got["last"].value is None and "short read" in got["last"].error and got["first"].error is None and got["first"].value == 1
    with pytest.raises(RuntimeError, match="short read"):
        one.sample_points(spots.filter("name = 'last'"), ["red"])


def test_every_tile_of_a_window_is_read(spark, tmp_path):
    a = np.full((70, 40), -1, "int16")
    a[66, 35] = 5  # in the last, partial row of tiles, whose other pixels are nodata, as are those of all other tiles
    a[20, 5] = 7  # in a tile between that of the centre and that of the window's border
    write.write(str(tmp_path / "w.tif"), a[:, :, None], tile=16, transform=(0.1, 10, -0.1, 50), nodata=-1)
    c = Collection(spark.createDataFrame([("w", datetime(2024, 1, 1), None, {"red": (str(tmp_path / "w.tif"), 0)}, (10.0, 43.0, 14.0, 50.0))], SCHEMA))
    at = lambda row, col: (10.05 + col * 0.1, 49.95 - row * 0.1)
    value = lambda p, d: c.sample_points(pts(spark, [("p", *p)]), ["red"], max_distance=d).first().value
    assert value(at(63, 35), 7) == 5  # the window ends beyond the raster
    assert value(at(5, 5), 27) == 7


def test_area_reads(spark, scenes):
    aois = spark.createDataFrame([(1, G.box(11.02, 49.72, 11.28, 49.98), "x"), (2, G.box(60, 60, 61, 61), "y")], "geometry_id long, geometry binary, crop string")
    rows = {r.record: r for r in scenes.area_frame(aois, ["red"], partitions=2).collect()}
    assert set(rows) == {"s0", "s1", "gone"} and rows["gone"].error and rows["s0"].crop == "x" and (rows["s0"].height, rows["s0"].width) == (3, 3)
    two = Collection(scenes.df.filter("id IN ('s0', 's1')"))
    stack = two.get_numpy(aois, ["red", "nir"], partitions=2)
    assert stack.shape == (2, 2, 3, 3) and (stack[:, 1] - stack[:, 0] == 5).all()
    px = read.long_pixels(two.area_frame(aois, ["red"], partitions=2))
    assert px.count() == 18 and px.agg({"x": "min"}).first()[0] == pytest.approx(11.05)
    x, y = crs.transform([11.0, 11.3], [49.7, 50.0], 4326, 3857)
    merc = spark.createDataFrame([(1, G.box(x[0], y[0], x[1], y[1]))], "geometry_id long, geometry binary")
    assert two.area_frame(merc, ["red"], geometry_epsg=3857, partitions=2).filter("error IS NULL").count() == 2


def test_enrich(spark, scenes):
    e = {r.id: r for r in enrich.enrich(scenes.df, ["red"], partitions=2).collect()}
    assert e["s0"].red_metadata.image_width == 20 and e["gone"].red_metadata is None and e["u"]["proj:epsg"] == 32632 and e["u"].crs == "EPSG:32632"
    assert Collection.wrap(enrich.enrich(scenes.df, ["red"], partitions=2)).bands == ["red"]
    with pytest.raises(RuntimeError, match="no header"):
        enrich.enrich(scenes.df.filter("id = 'gone'"), ["red"])


def test_geometry_input():
    g = {"type": "Polygon", "coordinates": [[[0, 0, 9], [2, 0, 9], [2, 2, 9], [0, 0, 9]]]}
    b = G.from_geojson(g)
    assert G.to_geojson(b)["coordinates"][0][1] == [2, 0] and wkb.bounds(wkb.parse(b)) == (0, 0, 2, 2)
    m = {"type": "MultiPolygon", "coordinates": [g["coordinates"], g["coordinates"]]}
    assert G.to_geojson(G.from_geojson(json.dumps({"type": "Feature", "geometry": m})))["type"] == "MultiPolygon"
    assert len(G.coerce({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": g}] * 2})) == 2
    assert G.coerce((0, 0, 1, 1)) == [G.box(0, 0, 1, 1)] and G.coerce(pa.array([b, b])) == [b, b] and G.coerce([b, (0, 0, 1, 1)]) == [b, G.box(0, 0, 1, 1)]
    class Shape:
        __geo_interface__ = g
    assert G.coerce(Shape()) == [b]
    for bad in ({"type": "LineString", "coordinates": []}, 5):
        with pytest.raises(G.UnsupportedGeometry):
            G.coerce(bad)
    assert wkb.bounds(wkb.parse(G.transform(G.box(0, 0, 1, 1), 4326, 3857)))[2] == pytest.approx(111319.49, abs=0.01)
    r = G.random_points(b, 200)
    assert len(r) == 200 and (r[:, 1] <= r[:, 0] + 1e-12).all() and (G.random_points(b, 200) == r).all()
    assert G.xy_columns(["lat", "lon", "z"]) == ("lon", "lat") and G.xy_columns(["a", "b"], "b", "a") == ("b", "a")
    for args in ((["q"],), (["x", "y"], "x")):
        with pytest.raises(ValueError):
            G.xy_columns(*args)


def test_column_metadata(spark):
    from pyspark.sql import types as T

    def df(meta, name="geometry"):
        return spark.createDataFrame([], T.StructType([T.StructField(name, T.BinaryType(), True, meta)]))
    ext = lambda d: {"ARROW:extension:name": "geoarrow.wkb", "ARROW:extension:metadata": json.dumps(d)}
    assert G.column_crs(df(ext({"crs": "EPSG:32632"}))) == 32632 and G.column_crs(df(ext({"crs": "OGC:CRS84"}))) == 4326 and G.column_crs(df({})) is None
    with pytest.raises(ValueError, match="edges"):
        G.column_crs(df(ext({"edges": "spherical"})))
    assert G.geometry_column(df(ext({}), "shape")) == "shape" and G.geometry_column(df({})) == "geometry"
    with pytest.raises(ValueError):
        G.geometry_column(df({}, "other"))


def test_arrow_input(spark):
    t = pa.table({"a": [1, 2]})
    class Other:
        def to_arrow(self):
            return t
    for obj in (t, t.to_batches()[0], t.to_reader(), ds.dataset(t), Other(), {"a": [1, 2]}, spark.createDataFrame([(1,), (2,)], "a long")):
        assert sorted(r.a for r in arrow.as_dataframe(spark, obj).collect()) == [1, 2]


def test_capsule_export(spark, scenes):
    t = pa.RecordBatchReader.from_stream(Collection(scenes.df.select("id", "datetime"))).read_all()
    assert t.num_rows == 4 and len(list(scenes.batches(["id"]))) == 4


def test_numbering_stride_and_chips(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as v")
    assert {r.v: r.k for r in numbered(df, ["v"], "k").collect()} == {i: i for i in range(1000)}
    assert sorted(r.v for r in stride(df, ["v"], 250).collect()) == [0, 250, 500, 750]
    assert numbered(df.limit(0), ["v"], "k").count() == 0
    assert grid_chips(spark, (0, 0, 10, 6), 4, 3).count() == 3 and grid_chips(spark, (0, 0, 1, 1), 4, 3).count() == 0
    t = spark.createDataFrame([(datetime(2024, 1, d),) for d in (1, 2, 3)], "t timestamp_ntz")
    assert t.filter(in_slice(t.t, "2024-01-01", "2024-01-03")).count() == 2 and t.filter(in_slice(t.t, "2024-01-01", "2024-01-01")).count() == 1
    assert [label_value(v) for v in (True, np.int32(3), 2.5, float("nan"), None)] == [1, 3, 2.5, None, None]


def test_prefixed_source(tmp_path):
    (tmp_path / "f").write_bytes(b"0123")
    assert Prefixed(LocalBytes(), "x://").get_range(f"x://{tmp_path}/f", 1, 2) == b"12"
