"""Dataset descriptors, their registry, and the routing of ``build`` and ``load``."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from scenegrain.cloud import CloudConfig, configs
from scenegrain.cloud import source as cloud_source
from scenegrain.collection import Collection, list_collections
from scenegrain.functions import geometry
from scenegrain.functions import predicates as P
from scenegrain.functions.text import create_name
from scenegrain.ingest import enrich, normalize
from scenegrain.sources import hub, stac, store

SURFACES = ("record_table", "index", "collection")


@dataclass(frozen=True)
class Descriptor:
    """A dataset: what it is, where its surfaces are, and how its own names map to the contract.

    ``roles``: {contract field: own field}. ``surface_fields`` and ``filters``: what each surface holds and filters by.
    """

    id: str
    name: str = ""
    description: str = ""
    stac_api: str | None = None
    stac_collection: str | None = None
    static_catalog: bool = False
    record_table: str | None = None
    index: str | None = None
    collection: str | None = None
    roles: dict[str, str] = field(default_factory=dict)
    surface_fields: dict[str, list[str]] = field(default_factory=dict)
    filters: dict[str, list[str]] = field(default_factory=dict)
    band_map: dict[str, str] = field(default_factory=dict)
    band_index_map: dict[str, int] = field(default_factory=dict)
    temporal_range: tuple[str, str] | None = None
    cloud: dict = field(default_factory=dict)

    def __post_init__(self):
        if not self.id or self.id != self.id.strip():
            raise ValueError("a descriptor needs an id without outer blanks")
        for held in (self.surface_fields, self.filters):
            unknown = set(held) - set(SURFACES)
            if unknown:
                raise ValueError(f"unknown surfaces {sorted(unknown)}; known: {SURFACES}")
        if self.temporal_range and self.temporal_range[0] > self.temporal_range[1]:
            raise ValueError(f"{self.id}: the temporal range ends before it starts")
        if self.stac_api and not (self.stac_collection or self.static_catalog):
            raise ValueError(f"{self.id}: a service needs the name of a collection")
        if any(not isinstance(i, int) or i < 0 for i in self.band_index_map.values()):
            raise ValueError(f"{self.id}: band indices are whole numbers from 0")
        if len(set(self.roles.values())) < len(self.roles):
            raise ValueError(f"{self.id}: one field has two roles")
        if not any((self.stac_api, self.record_table, self.index, self.collection)):
            if not self.band_map and not self.band_index_map:
                raise ValueError(f"{self.id} names no source")

    def source_field(self, want: str) -> str:
        return self.roles.get(want, want)

    def has_field(self, surface: str, want: str) -> bool:
        """As declared; a surface that declares nothing may hold anything."""
        return surface not in self.surface_fields or want in self.surface_fields[surface]

    def filters_by(self, surface: str, want: str) -> bool:
        return want in self.filters[surface] if surface in self.filters else self.has_field(surface, want)

    @property
    def column_map(self) -> dict[str, str]:
        """{own field: contract field} of the fields that are columns, for the normaliser."""
        return {own: want for want, own in self.roles.items() if want != "href" and own != want}


class BandRegistry:
    """Band names to asset keys, by dataset id, so that two providers of one collection keep their own; the first registration by a descriptor stays."""

    _maps: dict[str, dict[str, str]] = {}

    @classmethod
    def register(cls, dataset: str, bands: dict[str, str], replace: bool = True) -> None:
        if replace or dataset not in cls._maps:
            cls._maps[dataset] = dict(bands)

    @classmethod
    def get(cls, dataset: str) -> dict[str, str]:
        """Of a dataset id; of a collection's name where all providers of it agree, else {}."""
        if dataset in cls._maps:
            return cls._maps[dataset]
        found = [cls._maps[d.id] for d in Registry.all() if d.stac_collection == dataset and d.id in cls._maps]
        return found[0] if found and all(m == found[0] for m in found) else {}

    @classmethod
    def known(cls) -> list[str]:
        return sorted(cls._maps)


class Registry:
    _all: dict[str, Descriptor] = {}

    @classmethod
    def register(cls, d: Descriptor) -> None:
        cls._all[d.id] = d
        if d.band_map:
            BandRegistry.register(d.id, d.band_map, replace=False)
        if d.cloud:
            configs.setdefault(d.id, CloudConfig(**d.cloud))

    @classmethod
    def unregister(cls, id_: str) -> None:
        cls._all.pop(id_)

    @classmethod
    def get(cls, id_: str) -> Descriptor | None:
        return cls._all.get(id_)

    @classmethod
    def all(cls) -> list[Descriptor]:
        return [cls._all[k] for k in sorted(cls._all)]

    @classmethod
    def search(cls, text: str) -> list[Descriptor]:
        """Ids, names and descriptions that contain the text, whatever case."""
        t = text.lower()
        return [d for d in cls.all() if t in f"{d.id}\n{d.name}\n{d.description}".lower()]

    @classmethod
    def frame(cls, spark: SparkSession) -> DataFrame:
        rows = [(d.id, d.name, d.description, d.stac_collection, sorted({**d.band_map, **d.band_index_map})) for d in cls.all()]
        return spark.createDataFrame(rows, "id string, name string, description string, stac_collection string, bands array<string>")


# Public STAC services, their collections and the asset key of each band.
EARTH_SEARCH = "https://earth-search.aws.element84.com/v1"
PLANETARY = "https://planetarycomputer.microsoft.com/api/stac/v1"
SENTINEL2 = {
    "B01": "coastal", "B02": "blue", "B03": "green", "B04": "red", "B05": "rededge1", "B06": "rededge2", "B07": "rededge3",
    "B08": "nir", "B8A": "nir08", "B09": "nir09", "B11": "swir16", "B12": "swir22", "SCL": "scl",
}
LANDSAT = {
    "B1": "coastal", "B2": "blue", "B3": "green", "B4": "red", "B5": "nir08", "B6": "swir16", "B7": "swir22",
    "qa_aerosol": "qa_aerosol", "qa_pixel": "qa_pixel", "qa_radsat": "qa_radsat",
}
_USGS = {"region": "us-west-2", "requester_pays": True, "prefixes": {"https://landsatlook.usgs.gov/data/": "s3://usgs-landsat/"}}
BUILT_IN = [
    Descriptor("earthsearch/sentinel-2-l2a", "Sentinel-2 Level-2A", "Multi-spectral, 10 to 60 m", EARTH_SEARCH, "sentinel-2-l2a", band_map=SENTINEL2),
    Descriptor("earthsearch/landsat-c2-l2", "Landsat Collection 2 Level-2", "Optical and thermal, 30 m", EARTH_SEARCH, "landsat-c2-l2", band_map=LANDSAT, cloud=_USGS),
    Descriptor("earthsearch/naip", "NAIP", "Aerial imagery, 1 m", EARTH_SEARCH, "naip", band_map=dict.fromkeys(("R", "G", "B", "NIR"), "image"), band_index_map={"R": 0, "G": 1, "B": 2, "NIR": 3}, cloud={"region": "us-west-2", "requester_pays": True}),
    Descriptor("earthsearch/cop-dem-glo-30", "Copernicus DEM 30 m", "Elevation", EARTH_SEARCH, "cop-dem-glo-30", band_map={"DEM": "data"}),
    Descriptor("earthsearch/cop-dem-glo-90", "Copernicus DEM 90 m", "Elevation", EARTH_SEARCH, "cop-dem-glo-90", band_map={"DEM": "data"}),
    Descriptor("pc/sentinel-2-l2a", "Sentinel-2 Level-2A", "Multi-spectral, 10 to 60 m, Azure mirror", PLANETARY, "sentinel-2-l2a", band_map={b: b for b in SENTINEL2}),
    Descriptor("pc/io-lulc-annual-v02", "Land use and cover 10 m", "Annual classes", PLANETARY, "io-lulc-annual-v02", band_map={"LULC": "data"}),
    Descriptor("pc/alos-dem", "ALOS World 3D 30 m", "Elevation", PLANETARY, "alos-dem", band_map={"DEM": "data"}),
    Descriptor("pc/nasadem", "NASADEM", "Elevation, 30 m", PLANETARY, "nasadem", band_map={"DEM": "elevation"}),
    Descriptor("pc/esa-worldcover", "ESA WorldCover", "Land cover, 10 m", PLANETARY, "esa-worldcover", band_map={"MAP": "map"}),
    Descriptor("pc/usda-cdl", "Cropland Data Layer", "Crop classes, 30 m", PLANETARY, "usda-cdl", band_map={"CDL": "cultivated"}),
    Descriptor(
        "aef/v1-annual", "Annual foundation embeddings", "64 bands of int8, 10 m",
        roles={"id": "fid", "geometry": "geom", "datetime": "year", "href": "path", "proj:epsg": "crs"},
        filters={s: ["id", "bbox", "datetime", "year", "utm_zone"] for s in SURFACES}, band_index_map={f"A{i:02d}": i for i in range(64)},
    ),
]
for _d in BUILT_IN:
    Registry.register(_d)


# ---- user registry ------------------------------------------------------------------------------------


def local_path(path: str | None = None) -> Path:
    return Path(path or os.environ.get("SCENEGRAIN_DATASETS") or Path.home() / ".scenegrain" / "datasets.json").expanduser()


def load_local(path: str | None = None) -> list[Descriptor]:
    at = local_path(path)
    return [Descriptor(**{**r, "temporal_range": tuple(r["temporal_range"]) if r.get("temporal_range") else None}) for r in json.loads(at.read_text())] if at.exists() else []


def save_local(d: Descriptor, path: str | None = None) -> None:
    at = local_path(path)
    kept = [x for x in load_local(path) if x.id != d.id]
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(json.dumps([asdict(x) for x in [*kept, d]], indent=1))


def remove_local(id_: str, path: str | None = None) -> bool:
    at, kept = local_path(path), [x for x in load_local(path)]
    if not any(x.id == id_ for x in kept):
        return False
    at.write_text(json.dumps([asdict(x) for x in kept if x.id != id_], indent=1))
    return True


def export_local(id_: str, to: str, path: str | None = None) -> None:
    found = next((x for x in load_local(path) if x.id == id_), None) or Registry.get(id_)
    if found is None:
        raise KeyError(id_)
    Path(to).write_text(json.dumps(asdict(found), indent=1))


def register_local(spark: SparkSession, name: str, path: str, persist: bool = True, registry: str | None = None) -> Descriptor:
    """Register a collection on disk under ``local/{name}``, with its dates."""
    a = Collection.from_parquet(spark, path).df.agg(F.min("datetime").cast("date").cast("string"), F.max("datetime").cast("date").cast("string")).first()
    d = Descriptor(f"local/{name}", name, collection=path, temporal_range=(a[0], a[1]) if a[0] else None)
    Registry.register(d)
    if persist:
        save_local(d, registry)
    return d


# ---- build and load -----------------------------------------------------------------------------------


def load(spark: SparkSession, path: str, name: str = "") -> Collection:
    """A registered dataset's surfaces, a dataset address, or a path."""
    d = Registry.get(path)
    if d is not None:
        if not d.collection:
            raise ValueError(f"{path} has no published collection; build it")
        return Collection.from_parquet(spark, d.collection, name or d.name, index_path=d.index, roles=d.roles)
    if path.startswith("hf://"):
        return Collection(hub.read(spark, path), name)
    return Collection.from_parquet(spark, path, name)


def build_from_table(spark: SparkSession, table: DataFrame | str, name: str, *, workspace: str | None = None, force: bool = False, enrich_bands: Sequence[str] | None = None, bbox=None, date_range=None, **kw) -> Collection:
    """From a DataFrame or Parquet: filters first, then normalise, parse headers if wanted, persist. An existing result is opened unless ``force``."""
    path = f"{workspace.rstrip('/')}/{name}_records" if workspace else None
    if path and not force and store.exists(spark, path):
        return Collection.from_parquet(spark, path, name, validate=False)
    df = spark.read.parquet(table) if isinstance(table, str) else table
    if bbox is not None:
        df = df.filter(P.bbox_overlaps(P.check_bbox(bbox, strict=True)))
    if date_range is not None:
        column = next((own for own, want in kw.get("column_map", {}).items() if want == "datetime"), "datetime")
        df = df.filter(P.date_between(*date_range, column=column, kind=dict(df.dtypes)[column]))
    df = normalize.normalise(df, **kw)
    if enrich_bands:
        df = enrich.enrich(df, enrich_bands)
    c = Collection(df, name, data_source=normalize.infer_data_source(df))
    if path:
        c.export(path)
        c = Collection.from_parquet(spark, path, name)
    return c


def footprint(json_text: Column) -> Column:
    """WKB of GeoJSON text; null for none, or for what isn't polygonal."""

    @F.arrow_udf(BinaryType())
    def parse(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            try:
                out.append(None if t is None else geometry.from_geojson(t))
            except (ValueError, KeyError, TypeError):
                out.append(None)
        return pa.array(out, pa.binary())

    return parse(json_text)


def build_from_stac(spark: SparkSession, name: str, stac_collection: str, bbox, date_range, *, items_path: str | None = None, workspace: str | None = None, force: bool = False, fetch=None, headers: bool = True, api: str | None = None, band_map: dict[str, str] | None = None, band_index_map: dict[str, int] | None = None, source=None) -> Collection:
    """From an item search. ``items_path``: items on disk, or a static catalog's root; ``api``: a live service, asked page by page; ``fetch(api params) -> list of item dicts`` for any other.

    ``band_map``: bands to asset keys; every asset must be there. Without it the registered map of the collection, else the one that most assets fit.
    ``band_index_map``: bands that are samples of their asset, which get assets of their own.
    """
    P.check_bbox(bbox, strict=True)
    full = create_name(name, date_range, stac_collection)
    path = f"{workspace.rstrip('/')}/{full}_stac" if workspace else None
    if path and not force and store.exists(spark, path):
        return Collection.from_parquet(spark, path, full, validate=False)
    if items_path:
        files = list(stac.crawl(items_path)) if items_path.endswith("catalog.json") else [items_path]
        rows = stac.read_items(spark, files[0]) if len(files) == 1 else stac.items(spark.read.text(files, wholetext=True))
    elif fetch is not None or api is not None:
        fetch = fetch or (lambda q: stac.search_service(api, q))
        found = stac.with_retries(lambda: fetch({"collections": [stac_collection], "bbox": list(bbox), "datetime": "/".join(date_range)}))
        rows = stac.items(spark.createDataFrame([(json.dumps(i),) for i in found], "value string"))
    else:
        raise ValueError("a live search needs a service or a fetch function")
    rows = stac.search(rows, bbox, date_range)
    keys = {r.k for r in rows.select(F.explode(F.map_keys("assets")).alias("k")).distinct().collect()}  # the names of assets: a few
    if band_map is not None:
        if keys:
            enrich.check_band_map(band_map, keys)
        bands = band_map
    else:
        bands = BandRegistry.get(stac_collection) or enrich.infer_band_map(keys, {k: BandRegistry.get(k) for k in BandRegistry.known()})
    asset = lambda v, i: F.struct(v["href"].alias("href"), F.lit(i).alias("band_index"))
    assets = F.transform_values("assets", lambda k, v: asset(v, 0)).cast(normalize.ASSETS)
    sampled = {b: i for b, i in (band_index_map or {}).items() if bands.get(b, b) in keys and b not in keys}
    if sampled:
        own = F.create_map(*[x for b, i in sampled.items() for x in (F.lit(b), asset(F.col("assets")[bands.get(b, b)], i))]).cast(normalize.ASSETS)
        assets = F.map_concat(assets, F.map_filter(own, lambda k, v: v["href"].isNotNull()))
    df = rows.withColumn("assets", assets).withColumn("geometry", footprint("geometry_json")).drop("geometry_json")
    df = normalize.normalise(df)
    if headers and bands:
        df = enrich.enrich(df, sorted({b if b in sampled else bands[b] for b in bands}), source=source)
    c = Collection(df, full, data_source=stac_collection, start_date=date_range[0], end_date=date_range[1])
    if path:
        c.export(path)
        c = Collection.from_parquet(spark, path, full)
    return c


def build(spark: SparkSession, dataset: str, name: str = "", *, bbox=None, date_range=None, workspace: str | None = None, **kw) -> Collection:
    """Route a dataset id: read-ready collection, record table, or item search (which needs bbox and date_range)."""
    d = Registry.get(dataset)
    if d is None:
        raise KeyError(f"unknown dataset {dataset}; known: {[x.id for x in Registry.all()]}")
    if d.collection:
        c = load(spark, dataset, name)
        extra = {k: v for k, v in (("bbox", bbox), ("date_range", date_range)) if v is not None}
        return c.subset(**extra) if extra else c
    if d.record_table and (kw.pop("prefer_table", True) or not d.stac_api):
        return build_from_table(spark, d.record_table, name or d.id.replace("/", "-"), workspace=workspace, bbox=bbox, date_range=date_range, column_map=d.column_map, href=d.roles.get("href"), band_index_map=d.band_index_map or None, **kw)
    if d.stac_collection and (bbox is None or date_range is None):
        raise ValueError(f"{dataset} is searched, so it needs bbox and date_range")
    if not d.stac_collection:
        raise ValueError(f"{dataset} has no surface with an address; give it one by registering a descriptor of the same id")
    if "items_path" not in kw and "fetch" not in kw:
        kw["api"] = d.stac_api
    return build_from_stac(spark, name or d.id.replace("/", "-"), d.stac_collection, bbox, date_range, workspace=workspace, band_map=kw.pop("band_map", None) or d.band_map or None, band_index_map=d.band_index_map or None, source=kw.pop("source", None) or cloud_source(configs.get(d.id)), **kw)


__all__ = ["BandRegistry", "Descriptor", "Registry", "build", "build_from_stac", "build_from_table", "list_collections", "load", "register_local"]
