"""Record tables into the collection contract."""

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenegrain.collection import BBOX, REQUIRED, Collection
from scenegrain.functions import crs, wkb
from scenegrain.functions.predicates import name

ASSETS = T.MapType(T.StringType(), T.StructType([T.StructField("href", T.StringType()), T.StructField("band_index", T.IntegerType())]))


def alias_columns(df: DataFrame, column_map: dict[str, str]) -> DataFrame:
    """{own: contract} names: the contract name is added where it is absent, the own one stays."""
    for own, want in column_map.items():
        if own in df.columns and want not in df.columns:
            df = df.withColumn(want, name(own))
    return df


def assets_from_href(df: DataFrame, href: str, band_index_map: dict[str, int]) -> DataFrame:
    """One file for all bands: {band: (href, band_index)}; a null href gives no assets."""
    pairs = [x for b, i in band_index_map.items() for x in (F.lit(b), F.struct(name(href).alias("href"), F.lit(i).cast("int").alias("band_index")))]
    return df.withColumn("assets", F.when(name(href).isNull(), F.create_map().cast(ASSETS)).otherwise(F.create_map(*pairs).cast(ASSETS)))


def assets_map(df: DataFrame) -> DataFrame:
    """Struct assets, whose fields vary from file to file, as a map without the absent ones."""
    t = df.schema["assets"].dataType
    if not isinstance(t, T.StructType):
        return df
    def entry(f: T.StructField) -> Column:
        a = F.col("assets")[f.name]
        own = {x.name for x in f.dataType.fields} if isinstance(f.dataType, T.StructType) else set()
        href = a["href"] if "href" in own else a.cast("string")
        index = a["band_index"].cast("int") if "band_index" in own else F.lit(0)
        return F.when(a.isNotNull(), F.struct(F.lit(f.name).alias("key"), F.struct(href.alias("href"), index.alias("band_index")).alias("value")))
    return df.withColumn("assets", F.when(F.col("assets").isNotNull(), F.map_from_entries(F.array_compact(F.array(*map(entry, t.fields)))).cast(ASSETS)))


def prepare_records(df: DataFrame) -> DataFrame:
    """``id`` as text; a whole-number ``datetime`` is a year and means its first moment."""
    if "id" in df.columns and not isinstance(df.schema["id"].dataType, T.StringType):
        df = df.withColumn("id", F.col("id").cast("string"))
    if "datetime" in df.columns and isinstance(df.schema["datetime"].dataType, (T.IntegerType, T.LongType, T.ShortType)):
        y = F.col("datetime").cast("int")
        df = df.withColumn("datetime", F.when(y.isNotNull(), F.make_timestamp_ntz(y, *[F.lit(v) for v in (1, 1, 0, 0, 0)])))
    if "geometry" in df.columns and isinstance(df.schema["geometry"].dataType, T.NullType):
        df = df.withColumn("geometry", F.lit(None).cast("binary"))
    return df


def crs_sidecars(df: DataFrame) -> DataFrame:
    """``proj:epsg`` and ``crs`` per row, each from the first of proj:code, proj:epsg, crs, proj:wkt2, proj:projjson that tells."""
    have = [c for c in ("proj:code", "proj:epsg", "crs", "proj:wkt2", "proj:projjson") if c in df.columns]
    if not have:
        return df
    def code(c: str) -> Column:
        if c == "proj:projjson":
            return F.when(F.upper(F.get_json_object(name(c), "$.id.authority")) == "EPSG", F.get_json_object(name(c), "$.id.code").try_cast("int"))
        return name(c).cast("int") if c == "proj:epsg" else crs.epsg_column(name(c).cast("string"))
    epsg = F.coalesce(*map(code, have))
    other = [F.when(name(c) != "", name(c)) for c in ("crs", "proj:code") if c in df.columns]
    return df.withColumns({"proj:epsg": epsg.cast("int"), "crs": F.coalesce(crs.crs_code_column(epsg), *other, F.lit(None).cast("string"))})


@F.pandas_udf(BBOX)
def wkb_bbox(col: pd.Series) -> pd.DataFrame:
    out = [(None,) * 4 if (p := wkb.parse(g)) is None else wkb.bounds(p) for g in col]
    return pd.DataFrame(out, columns=["xmin", "ymin", "xmax", "ymax"], dtype="float64")


@F.pandas_udf(T.BinaryType())
def box_wkb(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    """A box as a polygon; null where a side is."""
    ok = ~(x0.isna() | y0.isna() | x1.isna() | y1.isna())
    return pd.Series([wkb.polygon([(a, b), (c, b), (c, d), (a, d), (a, b)]) if k else None for a, b, c, d, k in zip(x0, y0, x1, y1, ok)])


def geometry_bbox(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Adds ``bbox`` from the footprints; unreadable ones give null."""
    df = df.withColumn("bbox", wkb_bbox(name(geometry)))
    return df.withColumn("bbox", F.when(F.col("bbox.xmin").isNotNull(), F.col("bbox")))


def box_struct(df: DataFrame) -> DataFrame:
    """A list ``bbox`` as a struct; a missing one from the footprints."""
    if "bbox" not in df.columns:
        return geometry_bbox(df) if "geometry" in df.columns else df
    if isinstance(df.schema["bbox"].dataType, T.ArrayType):
        b = F.col("bbox")
        return df.withColumn("bbox", F.when(F.size(b) == 4, F.struct(*[b[i].cast("double").alias(n) for i, n in enumerate(("xmin", "ymin", "xmax", "ymax"))])))
    return df


def with_partitions(df: DataFrame) -> DataFrame:
    """``year`` and ``month`` of ``datetime`` where absent."""
    for part, f in (("year", F.year), ("month", F.month)):
        if part not in df.columns and "datetime" in df.columns:
            df = df.withColumn(part, f("datetime").cast("int"))
    return df


def to_crs84(df: DataFrame, epsg: int) -> DataFrame:
    """Footprints in another system as lon/lat; a box from before is dropped, as it no longer holds."""
    if epsg == 4326:
        return df
    schema = df.drop("bbox").schema
    at = schema.fieldNames().index("geometry")

    def run(batches):
        for b in batches:
            b = b.select(schema.fieldNames())
            out = []
            for g in b.column(at).to_pylist():
                p = wkb.parse(g)
                out.append(None if p is None else wkb.multipolygon(*[[np.column_stack(crs.transform(r[:, 0], r[:, 1], epsg, 4326)) for r in rings] for rings in p]) if len(p) > 1 else wkb.polygon(*[np.column_stack(crs.transform(r[:, 0], r[:, 1], epsg, 4326)) for r in p[0]]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()) if i == at else b.column(i) for i in range(b.num_columns)], names=schema.fieldNames())

    return df.drop("bbox").mapInArrow(run, schema)


def normalise(df: DataFrame, *, column_map: dict[str, str] | None = None, href: str | None = None, band_index_map: dict[str, int] | None = None, geometry_epsg: int = 4326) -> DataFrame:
    """The whole chain, one lazy plan: names, id and time, assets, coordinate systems, bbox, partitions."""
    df = prepare_records(alias_columns(df, column_map or {}))
    if href and band_index_map and "assets" not in df.columns:
        df = assets_from_href(df, href, band_index_map)
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return with_partitions(box_struct(crs_sidecars(assets_map(to_crs84(df, geometry_epsg)))))


def build_collection(df: DataFrame, name_: str = "", partition_cols: Sequence[str] = ("year", "month"), workspace: str | None = None, **kw) -> Collection:
    """Normalise, and with a ``workspace`` persist as ``{name}_records`` and open again."""
    meta = {k: kw.pop(k) for k in ("description", "data_source", "start_date", "end_date") if k in kw}
    c = Collection(normalise(df, **kw), name=name_, **meta)
    if workspace:
        path = f"{workspace.rstrip('/')}/{name_}_records"
        c.export(path, partition_cols)
        c = Collection.from_parquet(df.sparkSession, path, name_)
    return c


def infer_data_source(df: DataFrame, explicit: str = "") -> str:
    """The given one, else the first non-empty ``collection``, in order of the text."""
    if explicit:
        return explicit
    if "collection" not in df.columns:
        return ""
    return df.filter("collection IS NOT NULL AND collection <> ''").agg(F.min("collection")).first()[0] or ""
