import io
import json

import numpy as np
import pytest

from scenegrain import catalog, cloud
from scenegrain.functions import wkb
from scenegrain.ingest import enrich
from scenegrain.sources import stac
from scenegrain.sources.bytes import LocalBytes, Retrying, Routed
from scenegrain.tiff import write

BOX, DATES = (0, 0, 30, 30), ("2024-01-01", "2024-12-31")


def item(id_, assets, geometry=None):
    return json.dumps({"type": "Feature", "id": id_, "collection": "c", "bbox": [10, 8, 12, 10], "geometry": geometry, "properties": {"datetime": "2024-05-01T00:00:00Z"}, "assets": {k: {"href": v} for k, v in assets.items()}})


def test_two_providers_of_one_collection_keep_their_bands():
    a, b = catalog.BandRegistry.get("earthsearch/sentinel-2-l2a"), catalog.BandRegistry.get("pc/sentinel-2-l2a")
    assert a["B01"] == "coastal" and b["B01"] == "B01" and catalog.BandRegistry.get("sentinel-2-l2a") == {}
    assert cloud.configs["earthsearch/naip"].requester_pays and "naip" not in cloud.configs
    s = cloud.source(cloud.configs["earthsearch/landsat-c2-l2"])
    assert s.inner.prefixes and not s.inner.anonymous and cloud.source(None).inner.anonymous


def test_bands_that_are_samples_of_one_asset_differ(spark, tmp_path):
    write.write(str(tmp_path / "n.tif"), np.dstack([np.full((20, 20), v, "uint8") for v in (1, 2, 3, 4)]), tile=16, transform=(0.1, 10, -0.1, 10))
    square = {"type": "Polygon", "coordinates": [[[10, 8], [12, 8], [12, 10], [10, 10], [10, 8]]]}
    (tmp_path / "i.ndjson").write_text(item("n", {"image": str(tmp_path / "n.tif"), "thumb": "t.png"}, square) + "\n" + item("m", {"image": str(tmp_path / "n.tif")}, {"type": "Point", "coordinates": [1, 2]}) + "\n" + item("x", {"image": str(tmp_path / "n.tif")}, {"type": "Odd"}))
    c = catalog.build(spark, "earthsearch/naip", bbox=BOX, date_range=DATES, items_path=str(tmp_path / "i.ndjson"), source=LocalBytes())
    p = spark.createDataFrame([(1, 11.0, 9.0)], "point_index long, lon double, lat double")
    got = {(r.record_id, r.band): r.value for r in c.sample_points(p, ["R", "G", "B", "NIR"], index="point_index").collect()}
    assert got == {(i, b): float(v) for i in "nmx" for v, b in enumerate(("R", "G", "B", "NIR"), 1)}
    rows = {r.id: r for r in c.df.collect()}
    assert wkb.bounds(wkb.parse(rows["n"].geometry)) == (10, 8, 12, 10) and wkb.parse_point(rows["m"].geometry) == (1, 2) and rows["x"].geometry is None
    assert rows["n"].R_metadata.samples_per_pixel == 4


def test_band_maps_are_checked_or_inferred(spark, tmp_path):
    (tmp_path / "i.ndjson").write_text(item("a", {"coastal": "c.tif", "red": "r.tif", "scl": "s.tif"}))
    with pytest.raises(ValueError, match="without an asset"):
        catalog.build_from_stac(spark, "t", "c", BOX, DATES, items_path=str(tmp_path / "i.ndjson"), headers=False, band_map={"B99": "gone"})
    with pytest.raises(RuntimeError, match="no header"):  # the map is inferred, so headers are sought
        catalog.build_from_stac(spark, "t", "c", BOX, DATES, items_path=str(tmp_path / "i.ndjson"), source=LocalBytes())


def test_descriptors_are_checked():
    for kw in ({"stac_api": "u"}, {"collection": "p", "temporal_range": ("2024", "2023")}, {"collection": "p", "band_index_map": {"a": -1}}, {"collection": "p", "roles": {"id": "x", "bbox": "x"}}, {}):
        with pytest.raises(ValueError):
            catalog.Descriptor("x", **kw)


def test_a_dataset_without_an_address_says_so(spark):
    with pytest.raises(ValueError, match="no surface with an address"):
        catalog.build(spark, "aef/v1-annual")


def test_one_crs_is_strict(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), ("c", None)], "id string, epsg int")
    assert {(r.id, r.epsg, r.conflict) for r in enrich.one_crs(df, "id", "epsg").collect()} == {("a", 1, False), ("b", None, True), ("c", None, False)}
    assert enrich.one_crs(df.filter("id = 'a'"), "id", "epsg", strict=True).count() == 1
    for bad in "bc":
        with pytest.raises(Exception, match=f"systems of {bad}"):
            enrich.one_crs(df.filter(f"id = '{bad}'"), "id", "epsg", strict=True).collect()


def test_a_search_follows_its_pages():
    asked = []

    def opener(request, timeout):
        asked.append((request.full_url, request.data and json.loads(request.data)))
        n = len(asked)
        link = [{"rel": "next", "method": "POST", "href": "http://u/search", "body": {"token": "x"}, "merge": True}] if n == 1 else [{"rel": "next", "href": "http://u/more?p=3"}] if n == 2 else []
        return io.BytesIO(json.dumps({"features": [{"id": n}], "links": link}).encode())

    got = stac.search_service("http://u/", {"collections": ["c"]}, opener=opener)
    assert [x["id"] for x in got] == [1, 2, 3] and asked[1] == ("http://u/search", {"collections": ["c"], "limit": 250, "token": "x"}) and asked[2] == ("http://u/more?p=3", None)


def test_sources_by_address(tmp_path):
    (tmp_path / "f").write_bytes(b"0123456789")
    s = Retrying(Routed({"x://": "file://"}), wait=0)
    assert s.get_ranges(f"x://{tmp_path}/f", [(1, 2), (8, 2)]) == [b"12", b"89"] and s.get_range(f"{tmp_path}/f", 0, 3) == b"012"
    with pytest.raises(OSError, match="short read"):
        s.get_range(f"{tmp_path}/f", 8, 9)
    with pytest.raises(FileNotFoundError):
        s.get_range(f"{tmp_path}/none", 0, 1)
