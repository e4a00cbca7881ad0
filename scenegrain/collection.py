"""A collection: one row per raster record, as a lazy DataFrame with a name and a contract."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenegrain.functions import predicates as P
from scenegrain.sources import store

REQUIRED = ("id", "datetime", "geometry", "assets")
SIDECAR = "_collection.json"
BBOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("xmin", "ymin", "xmax", "ymax")])


def _is_box(t: T.DataType) -> bool:
    return isinstance(t, T.StructType) and {"xmin", "ymin", "xmax", "ymax"} <= {f.name for f in t.fields}


def check_contract(df: DataFrame) -> None:
    """The required columns and a struct ``bbox``; raises ValueError naming what is missing."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    if "bbox" not in df.columns or not _is_box(df.schema["bbox"].dataType):
        raise ValueError("bbox must be a struct of xmin, ymin, xmax, ymax")


@dataclass(frozen=True)
class Collection:
    """An immutable view: every filter gives a new one. ``index`` is a narrow table of the same records, if there is one.

    ``roles`` maps contract names to the index's own (id, geometry, datetime, ...).
    """

    df: DataFrame
    name: str = ""
    description: str = ""
    data_source: str = ""
    start_date: str | None = None
    end_date: str | None = None
    index: DataFrame | None = None

    # ---- open ---------------------------------------------------------------------------------

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str, name: str = "", data_source: str = "", validate: bool = True, index_path: str | None = None, roles: dict[str, str] | None = None) -> Collection:
        """Open a collection; Hive partitions are found by Spark. Metadata comes from the sidecar where there is one."""
        df = spark.read.parquet(path)
        if validate:
            check_contract(df)
        meta = json.loads(store.read_text(spark, f"{path.rstrip('/')}/{SIDECAR}") or "{}")
        index = rename_roles(spark.read.parquet(index_path), roles or {}) if index_path else None
        fallback = os.path.basename(path.rstrip("/"))
        return cls(df, name or meta.get("name") or fallback, meta.get("description", ""), data_source or meta.get("data_source", ""), meta.get("start_date"), meta.get("end_date"), index)

    @classmethod
    def wrap(cls, df: DataFrame, require_band_metadata: bool = True, **meta) -> Collection:
        """A read-ready table as a collection."""
        check_contract(df)
        bands = [c for c in df.columns if c.endswith("_metadata")]
        if require_band_metadata and not bands:
            raise ValueError("no {band}_metadata column")
        need = {"image_width", "image_height", "tile_width", "tile_height", "dtype", "transform"}
        for c in bands:
            t = df.schema[c].dataType
            if not isinstance(t, T.StructType) or not need <= {f.name for f in t.fields}:
                raise ValueError(f"{c} must be a struct with {', '.join(sorted(need))}")
        return cls(df, **meta)

    # ---- filters ------------------------------------------------------------------------------

    def _with(self, cond: Column, needs: Sequence[str]) -> Collection:
        """The predicate goes to the index if it has the columns, and to the wide table likewise; both if both have."""
        df, index, hit = self.df, self.index, False
        if index is not None and set(needs) <= set(index.columns):
            index, hit = index.filter(cond), True
        if set(needs) <= set(df.columns):
            df, hit = df.filter(cond), True
        if not hit:
            raise ValueError(f"no such column: {', '.join(c for c in needs if c not in df.columns)}")
        return replace(self, df=df, index=index)

    def subset(self, *, cloud_cover_lt: float | None = None, date_range: tuple[str | None, str | None] | None = None, bbox: Sequence[float] | None = None, geometries: Sequence[Sequence[float]] | DataFrame | None = None, split: str | Sequence[str] | None = None, split_column: str = "split") -> Collection:
        """All criteria given must hold; none given is an error. ``geometries``: boxes, or for many a DataFrame with a ``bbox`` struct."""
        if all(x is None for x in (cloud_cover_lt, date_range, bbox, geometries, split)):
            raise ValueError("subset needs at least one criterion")
        c = self
        if cloud_cover_lt is not None:
            c = c._with(P.cloud_below(cloud_cover_lt), ["eo:cloud_cover"])
        if date_range is not None:
            kinds = dict(c.df.dtypes) | (dict(c.index.dtypes) if c.index is not None else {})
            kind = kinds.get("datetime", "timestamp_ntz")
            parts = [p for p in ("year", "month") if p in c.df.columns] if kind == dict(c.df.dtypes).get("datetime") else []
            c = c._with(P.date_between(*date_range, kind=kind, partitions=parts), ["datetime"])
        if bbox is not None:
            c = c._with(P.bbox_overlaps(bbox), ["bbox"])
        if isinstance(geometries, DataFrame):
            from scenegrain.operators.range_join import overlap_semi_join

            c = replace(c, df=overlap_semi_join(c.df, geometries))
        elif geometries is not None:
            c = c._with(P.any_bbox(geometries), ["bbox"])
        if split is not None:
            c = c._with(P.split_in(split, split_column), [split_column])
        return c

    def where(self, cond: Column | str) -> Collection:
        """Any expression; the index gets it if it has all the columns, else the wide table."""
        expr = F.expr(cond) if isinstance(cond, str) else cond
        for which in ("index", "df"):
            table = getattr(self, which)
            if table is None:
                continue
            try:
                filtered = table.filter(expr)
                filtered.schema  # noqa: B018  resolves the columns
                return replace(self, **{which: filtered})
            except Exception as e:
                if which == "df" or "UNRESOLVED" not in str(e):
                    raise
        return self

    def select_split(self, split: str | Sequence[str], split_column: str = "split") -> Collection:
        return self.subset(split=split, split_column=split_column)

    def rows(self, columns: Sequence[str] | None = None) -> DataFrame:
        """The plan: the wide table, semi-joined with the ids (and data shards) that the index still holds."""
        from scenegrain.plans.two_surface import restrict

        df = restrict(self.df, self.index)
        return df.select(*[P.name(c) for c in columns]) if columns else df

    def index_rows(self, columns: Sequence[str] | None = None, where: Column | str | None = None, limit: int | None = None, order: Sequence[str] = ("id",)) -> DataFrame:
        """The index alone, filtered, in order where it is limited; the wide table isn't read."""
        if self.index is None:
            raise ValueError("the collection has no index")
        i = self.index.filter(F.expr(where) if isinstance(where, str) else where) if where is not None else self.index
        i = i.orderBy(*[P.name(c) for c in order]).limit(limit) if limit is not None else i
        return i.select(*[P.name(c) for c in columns]) if columns else i

    def index_collection(self) -> Collection:
        """The index as a collection of its own, for searches that need no more than it holds."""
        return replace(self, df=self.index_rows(), index=None)

    # ---- look -----------------------------------------------------------------------------------

    def head(self, n: int = 5, columns: Sequence[str] | None = None, order: Sequence[str] = ("datetime", "id")) -> DataFrame:
        df = self.rows()
        df = df.orderBy(*[P.name(c) for c in order if c in df.columns]).limit(n)
        return df.select(*[P.name(c) for c in columns]) if columns else df

    def __len__(self) -> int:
        return self.rows().count()

    def batches(self, columns: Sequence[str] | None = None) -> Iterator:
        """Rows one partition at a time."""
        return self.rows(columns).toLocalIterator(prefetchPartitions=True)

    def to_arrow(self, columns: Sequence[str] | None = None):
        """An Arrow table; the geometry column says that it is WKB in lon/lat."""
        t = self.rows(columns).toArrow()
        if "geometry" in t.column_names:
            i = t.column_names.index("geometry")
            meta = {"ARROW:extension:name": "geoarrow.wkb", "ARROW:extension:metadata": json.dumps({"crs": "OGC:CRS84"})}
            t = t.cast(t.schema.set(i, t.schema.field(i).with_metadata(meta)))
        return t

    def __arrow_c_stream__(self, requested_schema=None):
        if requested_schema is not None:
            raise NotImplementedError("select columns before exporting; other schemas are not negotiated")
        return self.to_arrow().__arrow_c_stream__()

    @property
    def bands(self) -> list[str]:
        return [c.removesuffix("_metadata") for c in self.df.columns if c.endswith("_metadata")]

    def check_bands(self, bands: Sequence[str]) -> list[str]:
        unknown = [b for b in bands if b not in self.bands]
        if unknown:
            raise ValueError(f"unknown bands {unknown}; available: {self.bands}")
        return list(bands)

    def bounds(self) -> DataFrame:
        b = F.col("bbox")
        return self.rows().agg(F.min(b.xmin).alias("xmin"), F.min(b.ymin).alias("ymin"), F.max(b.xmax).alias("xmax"), F.max(b.ymax).alias("ymax"))

    def epsg(self) -> DataFrame:
        """Distinct EPSG codes."""
        return self.rows().select(P.name("proj:epsg").alias("epsg")).filter("epsg IS NOT NULL").distinct()

    def modal_epsg(self) -> DataFrame:
        """The most frequent EPSG code if there are several; ties go to the smallest."""
        per = self.rows().groupBy(P.name("proj:epsg").alias("epsg")).count().filter("epsg IS NOT NULL")
        best = per.agg(F.max(F.struct("count", (-F.col("epsg")).alias("e"))).alias("m"), F.count("*").alias("n"))
        return best.filter("n > 1").select((-F.col("m.e")).alias("epsg"))

    def describe(self) -> DataFrame:
        b = F.col("bbox")
        return self.rows().agg(
            F.count("*").alias("records"), F.min("datetime").alias("first"), F.max("datetime").alias("last"),
            F.min(b.xmin).alias("xmin"), F.min(b.ymin).alias("ymin"), F.max(b.xmax).alias("xmax"), F.max(b.ymax).alias("ymax"),
            (F.count_distinct(P.name("proj:epsg")) if "proj:epsg" in self.df.columns else F.lit(None).cast("long")).alias("crs_count"),
        )

    def compare_to_catalog(self, catalog_bands: Sequence[str], bbox: Sequence[float] | None = None, date_range: tuple[str, str] | None = None) -> DataFrame:
        """One row: bands of the catalog that are missing here and bands beyond it, and the records outside its box and dates."""
        b = F.col("bbox")
        outside = F.lit(False) if bbox is None else (b.xmin < bbox[0]) | (b.ymin < bbox[1]) | (b.xmax > bbox[2]) | (b.ymax > bbox[3])
        early, late = (None, None) if date_range is None else date_range
        away = F.lit(False) if date_range is None else (F.col("datetime").cast("date") < F.lit(early).cast("date")) | (F.col("datetime").cast("date") > F.lit(late).cast("date"))
        lists = {"missing_bands": sorted(set(catalog_bands) - set(self.bands)), "extra_bands": sorted(set(self.bands) - set(catalog_bands))}
        arrays = [F.array(*map(F.lit, v)).cast("array<string>").alias(k) for k, v in lists.items()]
        return self.rows().agg(F.count("*").alias("records"), F.count_if(outside).alias("outside_box"), F.count_if(away).alias("outside_dates")).select(*arrays, "records", "outside_box", "outside_dates")

    def missing_bands(self, catalog_bands: Sequence[str]) -> list[str]:
        return sorted(set(catalog_bands) - set(self.bands))

    # ---- pixels -----------------------------------------------------------------------------------

    def sample_points(self, points: DataFrame, bands: Sequence[str], **kw) -> DataFrame:
        """See ``read.sample_points``."""
        from scenegrain import read

        return read.sample_points(self, points, bands, **kw)

    def area_frame(self, aois: DataFrame, bands: Sequence[str], **kw) -> DataFrame:
        """See ``read.area_frame``."""
        from scenegrain import read

        return read.area_frame(self, aois, bands, **kw)

    def get_numpy(self, aois: DataFrame, bands: Sequence[str], **kw):
        """See ``read.get_numpy``."""
        from scenegrain import read

        return read.get_numpy(self, aois, bands, **kw)

    # ---- write ------------------------------------------------------------------------------------

    def export(self, path: str, partition_by: Sequence[str] = ("year", "month"), geoparquet: bool = True) -> None:
        """Partitioned Parquet of the filtered plan, zstd, with the sidecar and GeoParquet metadata in the footers."""
        from scenegrain.ingest.normalize import box_struct, with_partitions
        from scenegrain.sources.geoparquet import geo_metadata, stamp

        df = with_partitions(box_struct(self.rows())) if {"year", "month"} & set(partition_by) else box_struct(self.rows())
        parts = [c for c in partition_by if c in df.columns]
        # one shuffle by partition, so that a partition isn't scattered over as many files as there are tasks
        df = df.repartition(*parts) if parts else df
        df.write.mode("overwrite").partitionBy(*parts).option("compression", "zstd").option("maxRecordsPerFile", 50_000 * 20).parquet(path)
        meta = {"name": self.name, "description": self.description, "data_source": self.data_source, "start_date": self.start_date, "end_date": self.end_date}
        store.write_text(df.sparkSession, f"{path.rstrip('/')}/{SIDECAR}", json.dumps(meta))
        if geoparquet and "geometry" in df.columns:
            stamp(df.sparkSession, path, geo_metadata(df))


def rename_roles(index: DataFrame, roles: dict[str, str]) -> DataFrame:
    """The index under contract names: ``roles`` is {contract name: own name}; an href becomes ``path``."""
    for want, own in roles.items():
        if own in index.columns and want != own and want not in index.columns:
            index = index.withColumn(want, P.name(own))
    if "id" in index.columns:
        index = index.withColumn("id", F.col("id").cast("string"))
    return index


def list_collections(spark: SparkSession, workspace: str) -> DataFrame:
    """Name, kind, source, date range and rows of the collections in a folder, read in one job."""
    at = workspace.rstrip("/")
    found, tables = [], None
    for entry in store.folders(spark, at):
        kind = next((k for k in ("stac", "records") if entry.endswith(f"_{k}")), None)
        if kind:
            meta = json.loads(store.read_text(spark, f"{at}/{entry}/{SIDECAR}") or "{}")
            found.append((entry, re.sub(rf"_{kind}$", "", entry), kind, meta.get("data_source")))
            t = spark.read.parquet(f"{at}/{entry}").agg(F.min("datetime").cast("string").alias("first"), F.max("datetime").cast("string").alias("last"), F.count("*").alias("records")).withColumn("entry", F.lit(entry))
            tables = t if tables is None else tables.unionByName(t)
    if tables is None:
        return spark.createDataFrame([], "name string, kind string, data_source string, first string, last string, records long")
    names = spark.createDataFrame(found, "entry string, name string, kind string, data_source string")
    return names.join(tables, "entry").select("name", "kind", "data_source", "first", "last", "records").orderBy("name", "kind")
