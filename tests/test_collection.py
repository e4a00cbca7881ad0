import json
import os
from datetime import datetime

import pytest
from conftest import plan

from scenegrain import catalog, cli, cloud, options
from scenegrain.collection import Collection, list_collections
from scenegrain.functions import affine, crs, predicates as P, text, wkb
from scenegrain.ingest import enrich, normalize
from scenegrain.sources import geoparquet, hub, stac

SCHEMA = "id string, datetime timestamp_ntz, geometry binary, assets map<string, struct<href: string, band_index: int>>, bbox struct<xmin: double, ymin: double, xmax: double, ymax: double>, `eo:cloud_cover` double, split string"


def ring(x, y, s=1.0):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]


@pytest.fixture(scope="module")
def three(spark):
    rows = [
        ("scene-1", datetime(2024, 1, 15), wkb.polygon(ring(0, 0)), {"B04": ("a.tif", 0)}, (0.0, 0.0, 1.0, 1.0), 5.0, "train"),
        ("scene-2", datetime(2024, 2, 15), wkb.polygon(ring(10, 10)), {"B04": ("b.tif", 0)}, (10.0, 10.0, 11.0, 11.0), 40.0, "val"),
        ("scene-3", datetime(2024, 3, 15), None, {}, (20.0, 20.0, 21.0, 21.0), None, "test"),
    ]
    return Collection(spark.createDataFrame(rows, SCHEMA), "three")


def ids(c):
    return sorted(r.id for r in c.rows(["id"]).collect())


def test_filters(three):
    assert ids(three.subset(cloud_cover_lt=40)) == ["scene-1"]  # strict, null never passes
    assert ids(three.subset(date_range=("2024-01-15", "2024-02-15"))) == ["scene-1", "scene-2"]
    assert ids(three.subset(bbox=(1, 1, 10, 10))) == ["scene-1", "scene-2"]  # touching counts
    assert ids(three.subset(geometries=[(0, 0, 1, 1), (20, 20, 21, 21)])) == ["scene-1", "scene-3"]
    assert ids(three.subset(split=["val", "test"])) == ["scene-2", "scene-3"] and ids(three.select_split("train")) == ["scene-1"]
    assert ids(three.subset(cloud_cover_lt=50, split="val", bbox=(0, 0, 30, 30))) == ["scene-2"]
    assert ids(three.where("split = 'val'")) == ["scene-2"]
    assert len(three) == 3 and [r.id for r in three.head(2).collect()] == ["scene-1", "scene-2"]


@pytest.mark.parametrize("kw", [{}, {"cloud_cover_lt": 101}, {"bbox": (2, 0, 1, 1)}, {"date_range": ("2024-02-01", "2024-01-01")}, {"date_range": (None, None)}, {"split": []}, {"geometries": []}])
def test_bad_criteria(three, kw):
    with pytest.raises(ValueError):
        three.subset(**kw)


def test_many_geometries_join(spark, three):
    boxes = spark.createDataFrame([((0.5, 0.5, 0.6, 0.6),), ((0.5, 0.5, 9.0, 9.0),), (None,)], "bbox struct<xmin: double, ymin: double, xmax: double, ymax: double>")
    assert ids(three.subset(geometries=boxes)) == ["scene-1"]


def test_index_and_wide_agree(spark, three):
    index = three.df.selectExpr("id", "bbox", "year(datetime) as year")
    c = Collection(three.df, index=index)
    assert ids(c.where("year = 2024").subset(bbox=(0, 0, 5, 5))) == ["scene-1"]
    both = c.subset(cloud_cover_lt=10, bbox=(0, 0, 30, 30))  # the index has no cloud cover; the box still holds
    assert ids(both) == ["scene-1"] and len(both) == 1


def test_pushdown_and_partitions(spark, three, tmp_path):
    three.export(str(tmp_path / "c"))
    c = Collection.from_parquet(spark, str(tmp_path / "c"))
    assert c.name == "three" and len(c) == 3
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    p = plan(c.subset(cloud_cover_lt=10, bbox=(0, 0, 1, 1)).rows(["id"]))
    pushed = p.split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(bbox.xmax" in pushed and "LessThan(" in pushed and "cloud_cover" in pushed
    assert "assets" not in p.split("ReadSchema")[1] and "geometry" not in p.split("ReadSchema")[1]
    p = plan(c.subset(date_range=("2024-01-01", "2024-01-31")).rows(["id"]))
    assert "PartitionFilters: [" in p and "month" in p.split("PartitionFilters")[1].split("]")[0]


def test_geoparquet_footer(spark, three, tmp_path):
    import pyarrow.parquet as pq

    at = str(tmp_path / "g")
    three.export(at, partition_by=())
    file = next(os.path.join(at, f) for f in os.listdir(at) if f.endswith(".parquet"))
    geo = json.loads(pq.read_schema(file).metadata[b"geo"])
    assert geo["version"] == "1.1.0" and geo["columns"]["geometry"]["encoding"] == "WKB" and geo["columns"]["geometry"]["covering"]["bbox"]["xmin"] == ["bbox", "xmin"]
    assert spark.read.parquet(at).count() == 3
    assert [r[0] for r in geoparquet.geometry_types(three.df).collect()] == ["Polygon"]


def test_contract(spark, three):
    with pytest.raises(ValueError, match="missing required"):
        Collection.wrap(three.df.drop("assets"))
    with pytest.raises(ValueError, match="band_metadata|_metadata"):
        Collection.wrap(three.df)
    with pytest.raises(ValueError, match="unknown bands"):
        three.check_bands(["B99"])


def test_normalise(spark):
    df = spark.createDataFrame([(7, 2021, wkb.polygon(ring(1, 2)), "s3://x/a.tif", "EPSG:32632", "EPSG:4326"), (8, None, b"junk", None, None, "32633")], "fid long, year_ long, geom binary, path string, `proj:code` string, crs string")
    n = normalize.normalise(df, column_map={"fid": "id", "year_": "datetime", "geom": "geometry"}, href="path", band_index_map={"A00": 0, "A01": 1}).orderBy("fid").collect()
    assert n[0].id == "7" and n[0].datetime == datetime(2021, 1, 1) and n[0].bbox[:] == (1.0, 2.0, 2.0, 3.0) and n[0]["proj:epsg"] == 32632 and n[0].crs == "EPSG:32632" and n[0].year == 2021
    assert n[0].assets["A01"].band_index == 1 and n[1].assets == {} and n[1].bbox is None and n[1]["proj:epsg"] == 32633
    with pytest.raises(ValueError, match="missing required"):
        normalize.normalise(df.drop("path"))


def test_to_crs84_round_trip(spark):
    x, y = crs.transform([10.0, 10.1, 10.1, 10.0], [50.0, 50.0, 50.1, 50.1], 4326, 32632)
    df = spark.createDataFrame([("a", wkb.polygon(list(zip(x, y)) + [(x[0], y[0])]), 1)], "id string, geometry binary, bbox int")
    out = normalize.to_crs84(df, 32632)
    assert "bbox" not in out.columns
    b = wkb.bounds(wkb.parse(out.first().geometry))
    assert b == pytest.approx((10.0, 50.0, 10.1, 50.1), abs=1e-9)


def test_crs():
    # fixed points of a public projection library's documentation style: central meridian and equator
    assert crs.transform([9.0], [0.0], 4326, 32632)[0][0] == pytest.approx(500_000) and crs.transform([9.0], [0.0], 4326, 32732)[1][0] == pytest.approx(10_000_000)
    import numpy as np

    rng = np.random.default_rng(0)
    lon, lat = rng.uniform(6, 12, 200), rng.uniform(-80, 84, 200)
    for code in (32632, 32732, 3857):
        a, b = crs.transform(*crs.transform(lon, lat, 4326, code), code, 4326)
        assert np.allclose(a, lon, atol=1e-10) and np.allclose(b, lat, atol=1e-10)
    with pytest.raises(ValueError):
        crs.transform([0], [0], 4326, 2154)
    assert [crs.parse_epsg(v) for v in (32632, "EPSG:4326", " 3857 ", 'X[ID["EPSG",4326]],ID["EPSG",32631]]', {"id": {"authority": "EPSG", "code": 5}}, "WGS84", None, True)] == [32632, 4326, 3857, 32631, 5, None, None, None]
    b = crs.transform_bbox((0, 60, 6, 70), 4326, 32631)
    assert b[2] > crs.transform([6], [70], 4326, 32631)[0][0]  # the side bulges beyond its corners


def test_affine():
    assert affine.normalise((0.1, 0, 5, 0, -0.1, 9)) == (0.1, 5, -0.1, 9) and affine.normalise((1, 2, -1, 3)) == (1, 2, -1, 3)
    with pytest.raises(ValueError):
        affine.normalise((1, 0.1, 0, 0, -1, 0))
    assert affine.merge_shape((0, 0, 2.5, 3.5), (1, 1)) == (4, 2)  # halves to even
    assert affine.target_grid((0, 0, 2.5, 3.5), (1, 1)) == ((1, 0, -1, 3.5), 4, 3)


def test_texts():
    assert text.create_name("My Area_1!", ("2024-01-01", "2024-03-31"), "sentinel-2-l2a") == "my-area-1_202401-03_sentinel"
    assert text.create_name("x", ("2023-12-01", "2024-03-31"), "Foo/Bar 1") == "x_202312-202403_foo-bar-1"
    assert text.parse_name("a_202401-03_src_stac") == {"custom_name": "a", "data_source": "src", "name": "a_202401-03_src"} and text.parse_name("odd")["data_source"] is None
    assert text.rewrite_prefix("http://a/http://a/x", {"http://a/": "s3://b/"}) == "s3://b/http://a/x"
    assert text.parse_hf_uri("hf://datasets/o/n@r/data/x.parquet") == ("o/n", "r", "data/x.parquet")
    assert text.route_url("https://b.s3.eu-west-1.amazonaws.com/k") == ("s3", "b") and text.route_url("/data/x.tif") == ("local", "") and text.route_url("https://acc.blob.core.windows.net/c/k?sig=z")[0] == "http"


def test_hub_paths():
    files = ["README.md", "index.parquet", "data/b.parquet", "data/a.parquet", "x/c.parquet"]
    assert hub.resolve("hf://datasets/o/n", lambda r, v: files) == [f"hf://datasets/o/n/data/{x}.parquet" for x in "ab"]
    assert hub.resolve("hf://datasets/o/n@v1/x", lambda r, v: files) == ["hf://datasets/o/n@v1/x/c.parquet"]
    with pytest.raises(FileNotFoundError):
        hub.resolve("hf://datasets/o/n/none", lambda r, v: files)


def test_dnf(spark, three):
    both = P.dnf_and([[("split", "==", "train")], [("split", "==", "val")]], [[("bbox.xmin", ">=", 5.0)]])
    assert [r.id for r in three.df.filter(P.dnf(both)).collect()] == ["scene-2"]
    with pytest.raises(ValueError):
        P.dnf([[("a", "~", 1)]])


def test_stac(spark, tmp_path):
    item = lambda i, d, b: {"type": "Feature", "id": i, "collection": "c", "bbox": b, "properties": {"datetime": d, "eo:cloud_cover": 5.5}, "assets": {"red": {"href": f"{i}.tif"}}}
    docs = [item("a", "2024-01-31T23:00:00Z", [0, 0, 1, 1]), item("b", "2024-02-01T00:00:00Z", [0, 0, 0, 1, 1, 9]), item("z", None, [50, 50, 51, 51])]
    (tmp_path / "items.ndjson").write_text("\n".join(map(json.dumps, docs)) + "\nnot json\n")
    rows = stac.read_items(spark, str(tmp_path / "items.ndjson"))
    assert rows.count() == 3 and rows.filter("id = 'b'").first().bbox[:] == (0, 0, 1, 1)
    assert [r.id for r in stac.search(rows, (0, 0, 2, 2), ("2024-01-01", "2024-01-31")).collect()] == ["a"]  # the whole end day
    (tmp_path / "coll.json").write_text(json.dumps({"type": "FeatureCollection", "features": docs}))
    assert stac.read_items(spark, str(tmp_path / "coll.json")).count() == 3
    (tmp_path / "catalog.json").write_text(json.dumps({"type": "Catalog", "links": [{"rel": "item", "href": "a.json"}, {"rel": "child", "href": "sub/catalog.json"}, {"rel": "self", "href": "catalog.json"}]}))
    (tmp_path / "a.json").write_text(json.dumps(docs[0]))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/catalog.json").write_text(json.dumps({"type": "Catalog", "links": [{"rel": "item", "href": "b.json"}, {"rel": "child", "href": "../catalog.json"}]}))
    (tmp_path / "sub/b.json").write_text(json.dumps(docs[1]))
    assert [os.path.basename(p) for p in stac.crawl(str(tmp_path / "catalog.json"))] == ["a.json", "b.json"]
    c = catalog.build_from_stac(spark, "t", "c", (0, 0, 2, 2), ("2024-01-01", "2024-12-31"), items_path=str(tmp_path / "catalog.json"), workspace=str(tmp_path / "ws"), headers=False)
    assert sorted(ids(c)) == ["a", "b"] and list_collections(spark, str(tmp_path / "ws")).first().records == 2
    waits = []
    calls = iter([RuntimeError("503"), RuntimeError("timeout"), 7])
    def call():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x
    assert stac.with_retries(call, wait=waits.append) == 7 and waits == [1.0, 2.0]


def test_assets(spark):
    df = spark.createDataFrame([("r", {"blue": ("b.tif", None), "B04": ("r.tif", 2)})], "id string, assets map<string, struct<href: string, band_index: int>>")
    got = {(r.band, r.href, r.band_index) for r in enrich.resolve_bands(df, ["B02", "B04", "B99"], {"B02": "blue"}).collect()}
    assert got == {("B02", "b.tif", 0), ("B04", "r.tif", 2)}
    assert enrich.infer_band_map({"red", "nir"}, {"x": {"a": "red"}, "y": {"a": "red", "b": "nir"}}) == {"a": "red", "b": "nir"}
    with pytest.raises(ValueError):
        enrich.check_band_map({"B1": "gone"}, {"red"})
    j = spark.createDataFrame([('{"alternate": {"http": {"href": "h"}, "s3": {"href": "s"}}}',), ('{"href": "d"}',), ('{"links": [{"href": "l"}]}',)], "a string")
    assert [r[0] for r in j.select(enrich.asset_href(j.a)).collect()] == ["s", "d", "l"]


def test_catalog_registry(spark, three, tmp_path):
    assert len(catalog.BUILT_IN) == 12 and catalog.Registry.get("aef/v1-annual").source_field("id") == "fid" and catalog.Registry.get("aef/v1-annual").filters_by("index", "year")
    assert "earthsearch/naip" in [d.id for d in catalog.Registry.search("AERIAL")] and catalog.BandRegistry.get("naip")["R"] == "image"
    with pytest.raises(ValueError):
        catalog.Descriptor("x", surface_fields={"nowhere": []}, stac_api="u")
    three.export(str(tmp_path / "t_records"))
    reg = str(tmp_path / "reg.json")
    d = catalog.register_local(spark, "t", str(tmp_path / "t_records"), registry=reg)
    assert d.temporal_range == ("2024-01-15", "2024-03-15") and [x.id for x in catalog.load_local(reg)] == ["local/t"]
    assert len(catalog.load(spark, "local/t")) == 3 and ids(catalog.build(spark, "local/t", bbox=(0, 0, 2, 2))) == ["scene-1"]
    catalog.export_local("local/t", str(tmp_path / "one.json"), reg)
    assert catalog.remove_local("local/t", reg) and not catalog.remove_local("local/t", reg)
    catalog.Registry.unregister("local/t")
    with pytest.raises(KeyError):
        catalog.build(spark, "no/such")
    with pytest.raises(ValueError):
        catalog.build(spark, "earthsearch/naip")
    assert catalog.Registry.frame(spark).count() == 12


def test_cli(spark, three, tmp_path, capsys):
    three.df.write.parquet(str(tmp_path / "src"))
    ws = ["--workspace", str(tmp_path / "ws"), "--json"]
    assert cli.run(["collections", "import", "mine", str(tmp_path / "src"), *ws], spark) == 0
    assert json.loads(capsys.readouterr().out)["records"] == 3
    assert cli.run(["collections", "list", *ws], spark) == 0 and json.loads(capsys.readouterr().out)[0]["name"] == "mine"
    assert cli.run(["collections", "info", "mine", *ws], spark) == 0 and cli.run(["collections", "info", "gone", *ws], spark) == 1
    assert cli.run(["collections", "delete", "mine", *ws], spark) == 1 and cli.run(["collections", "delete", "mine", "--yes", *ws], spark) == 0
    assert cli.run(["datasets", "list"]) == 0 and cli.run(["datasets", "info", "pc/nasadem"]) == 0 and cli.run(["datasets", "search", "dem"]) == 0
    with pytest.raises(SystemExit):
        cli.run(["collections", "build", "x", "--collection", "c", "--bbox", "3,0,1,1"])


def test_options_and_cloud():
    with options.options(progress=True):
        assert options.get_options()["progress"]
    assert not options.get_options()["progress"]
    with pytest.raises(ValueError):
        options.set_options(nope=1)
    c = cloud.CloudConfig(requester_pays=True, prefixes={"https://landsatlook.usgs.gov/data/": "s3://usgs-landsat/"})
    assert cloud.bucket_settings(c) == {"usgs-landsat": {"region": "us-west-2", "request_payer": "true"}}
    assert cloud.hadoop_conf(c)["fs.s3a.bucket.usgs-landsat.requester.pays.enabled"] == "true"
    assert cloud.rewrite_url("https://landsatlook.usgs.gov/data/x", c) == "s3://usgs-landsat/x"


def test_incremental_ingest(spark, three, tmp_path):
    from scenegrain.sources.versions import current
    from scenegrain.streaming.incremental import ingest_stream

    src = three.df.selectExpr("*", "timestamp_ntz'2025-01-01' as ingested_at")
    inn, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    src.write.parquet(inn)
    ingest_stream(spark, inn, out, ck, src.schema).awaitTermination()
    assert spark.read.parquet(current(spark, out)).count() == 3
    src.filter("id = 'scene-1'").selectExpr("id", "datetime", "geometry", "assets", "bbox", "77.0D as `eo:cloud_cover`", "split", "timestamp_ntz'2025-02-01' as ingested_at").write.mode("append").parquet(inn)
    ingest_stream(spark, inn, out, ck, src.schema).awaitTermination()
    rows = spark.read.parquet(current(spark, out)).collect()
    assert len(rows) == 3 and {r.id: r["eo:cloud_cover"] for r in rows}["scene-1"] == 77.0


def test_two_surface_planning(spark, three, tmp_path):
    from scenegrain.plans import two_surface as T

    for k, part in enumerate(("part-00000.parquet", "part-00001.parquet")):
        three.df.filter(f"id = 'scene-{k + 1}'").selectExpr("id", f"'{part}' as source_part").toPandas().to_parquet(tmp_path / part)
    index = spark.createDataFrame([("scene-1", 2024, "part-00000.parquet"), ("scene-2", 2023, "part-00001.parquet")], "id string, year int, source_part string")
    only = T.open_shards(spark, str(tmp_path), index.filter("year = 2024"))
    assert [r.id for r in only.collect()] == ["scene-1"] and [os.path.basename(f) for f in only.inputFiles()] == ["part-00000.parquet"]
    assert T.open_shards(spark, str(tmp_path), index.filter("year = 1999")).count() == 0
    assert T.intersect((0, 0, 2, 2), (1, 1, 3, 3)) == (1, 1, 2, 2) and T.intersect(None, None) is None and T.intersect(None, (1, 2, 3, 4)) == (1, 2, 3, 4)
    aoi = spark.createDataFrame([((9.0, 9.0, 10.5, 10.5),)], "bbox struct<xmin: double, ymin: double, xmax: double, ymax: double>")
    assert [r.id for r in T.narrow(three.df, aoi).collect()] == ["scene-2"]
    gone = T.narrow(three.df, aoi, (50, 50, 60, 60))
    assert gone.count() == 0 and "Scan" not in plan(gone).replace("LocalTableScan", "")


def test_arrow_export_names_the_geometry(three):
    import pyarrow as pa

    t = three.to_arrow(["id", "geometry"])
    assert t.schema.field("geometry").metadata[b"ARROW:extension:name"] == b"geoarrow.wkb"
    assert pa.RecordBatchReader.from_stream(three).read_all().num_rows == 3


def test_scratch_tables_go_when_left(spark):
    from scenegrain import session

    kept = session.settled(spark, spark.range(3).toDF("i"), "kept")
    with session.scratch():
        inner = session.settled(spark, spark.range(5).toDF("i"), "inner")
        assert inner.count() == 5
        at = inner.inputFiles()[0].removeprefix("file://")
    assert kept.count() == 3 and not os.path.exists(at)


def test_hash_split_is_crc32(spark, tmp_path):
    import zlib

    from scenegrain.queries import records

    ids = [f"r{i}" for i in range(300)] + ["é", ""]
    spark.createDataFrame([(k, i) for k, i in enumerate(ids)] + [(999, None)], "fid long, id string").write.parquet(str(tmp_path / "records.parquet"))
    got = {r.fid: r.split for r in records.queries()["nm25_hash_split"](spark, str(tmp_path)).collect()}
    want = {k: (lambda h: "train" if h < 80 else "val" if h < 90 else "test")(zlib.crc32(i.encode()) % 100) for k, i in enumerate(ids)}
    assert got == want


def test_compare_to_catalog(three):
    r = three.compare_to_catalog(["red", "nir"], (0, 0, 2, 2), ("2024-01-01", "2024-02-01")).first()
    assert r.missing_bands == ["nir", "red"] and r.records == 3 and r.outside_box == 2 and r.outside_dates >= 1


def test_small_files_are_replaced_as_a_whole(spark, tmp_path):
    from scenegrain.sources import store

    at = f"file://{tmp_path}/a/b.txt"
    assert store.read_text(spark, at) is None and not store.exists(spark, at)
    store.write_text(spark, at, "one")
    store.write_text(spark, at, "zwei ü")
    assert store.read_text(spark, f"{tmp_path}/a/b.txt") == "zwei ü" and store.folders(spark, str(tmp_path)) == ["a"]
    assert not (tmp_path / "a/b.txt.new").exists()
