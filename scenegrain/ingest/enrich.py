"""Band assets: addresses to read, band resolution, and header metadata joined back onto records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenegrain.functions.predicates import name


def url_index(records: DataFrame, id_col: str = "id", bands: Sequence[str] | None = None) -> DataFrame:
    """Rows (record, band, href, band_index) of the assets that have an address; the band index defaults to 0."""
    r = records.select(F.col(id_col).alias("record"), F.explode(F.map_entries("assets")).alias("a"))
    r = r.select("record", F.col("a.key").alias("band"), F.col("a.value.href").alias("href"), F.coalesce("a.value.band_index", F.lit(0)).alias("band_index")).filter("href IS NOT NULL")
    return r.filter(F.col("band").isin(list(bands))) if bands else r


def resolve_bands(records: DataFrame, bands: Sequence[str], band_map: dict[str, str]) -> DataFrame:
    """Rows of the records with (band, href, band_index): a band is an asset by its own name, by the map, or by the map reversed."""
    back = {v: k for k, v in band_map.items()}
    def at(b: str) -> Column:
        return F.coalesce(*[F.col("assets")[k] for k in dict.fromkeys([b, band_map.get(b), back.get(b)]) if k])
    rows = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), at(b).alias("asset")) for b in bands]))
    r = records.select("*", rows.alias("r_")).filter("r_.asset.href IS NOT NULL")
    return r.select(*records.columns, F.col("r_.band").alias("band"), F.col("r_.asset.href").alias("href"), F.coalesce("r_.asset.band_index", F.lit(0)).alias("band_index"))


def preferred_href(assets: Column, keys: Sequence[str]) -> Column:
    """The address of the first asset present, e.g. an ``s3_`` sibling before the public one."""
    return F.coalesce(*[assets[k]["href"] for k in keys])


def asset_href(asset_json: Column) -> Column:
    """Of a STAC asset: href, else alternates in a fixed order, else the first link."""
    own = [F.get_json_object(asset_json, "$.href")]
    other = [F.get_json_object(asset_json, f"$.alternate.{k}.href") for k in ("s3", "aws", "https", "http", "cloudfront")]
    return F.coalesce(*own, *other, F.get_json_object(asset_json, "$.links[0].href"))


def infer_band_map(asset_keys: set[str], registered: dict[str, dict[str, str]]) -> dict[str, str]:
    """The registered map of which most assets are present; ties to the first name; {} if none fits."""
    hits = {k: len(asset_keys & set(m.values())) for k, m in registered.items()}
    best = min(hits, key=lambda k: (-hits[k], k), default=None)
    return registered[best] if best is not None and hits[best] else {}


def check_band_map(band_map: dict[str, str], asset_keys: set[str]) -> None:
    absent = sorted(b for b, a in band_map.items() if a not in asset_keys)
    if absent:
        raise ValueError(f"bands without an asset: {absent}; assets: {sorted(asset_keys)}")


def one_crs(records: DataFrame, key: str, epsg: str, strict: bool = False) -> DataFrame:
    """Rows (key, epsg, conflict): the one code of each group, null where there are several or none; ``strict``: several or none are an error."""
    e = name(epsg)
    g = records.groupBy(key).agg(F.min(e).alias("lo"), F.max(e).alias("hi"))
    if strict:
        said = F.concat(F.lit("systems of "), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.when(F.col("lo").isNull(), F.lit(": none")).otherwise(F.lit(": several")))
        kind = g.schema["lo"].dataType
        g = g.withColumn("lo", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.raise_error(said).cast(kind)))
    return g.select(key, F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("epsg"), F.coalesce(F.col("lo") != F.col("hi"), F.lit(False)).alias("conflict"))


def slice_tables(offsets: Column, band: Column, tiles_per_plane: Column) -> Column:
    """The part of a planar file's tile table that belongs to a band; null if the table doesn't reach so far."""
    first = band * tiles_per_plane
    return F.when(F.size(offsets) >= first + tiles_per_plane, F.slice(offsets, first + 1, tiles_per_plane)).when(F.size(offsets) == tiles_per_plane, offsets)


def with_headers(records: DataFrame, headers: DataFrame, bands: Sequence[str], id_col: str = "id") -> DataFrame:
    """``{band}_metadata`` columns from parsed headers (href, header struct): each file is parsed once, whoever refers to it."""
    u = url_index(records, id_col, bands).join(headers.select("href", "header"), "href", "left")
    wide = u.groupBy("record").pivot("band", list(bands)).agg(F.first("header", ignorenulls=True))
    wide = wide.select(F.col("record").alias(id_col), *[F.col(b).alias(f"{b}_metadata") for b in bands])
    return records.join(wide, id_col, "left")


def enrich(records: DataFrame, bands: Sequence[str], id_col: str = "id", partitions: int | None = None, source=None) -> DataFrame:
    """Parse the headers of all addresses, distinct, in parallel, and join them on.

    Files that fail have null metadata; that all fail is an error. ``proj:epsg`` and ``crs`` are filled from the
    headers where they are missing; bands of one record in different systems are an error.
    """
    from scenegrain.functions.crs import crs_code_column
    from scenegrain.session import settled, spread
    from scenegrain.tiff.header import parse_headers

    urls = url_index(records, id_col, bands).select("href").distinct()
    urls = urls.repartition(partitions, "href") if partitions else spread(urls, "href")
    heads = settled(records.sparkSession, parse_headers(urls, source=source), "headers")
    n = heads.agg(F.count("*").alias("n"), F.count("header").alias("ok"), F.min("error").alias("e")).first()
    if n.n and not n.ok:
        raise RuntimeError(f"no header could be parsed, e.g. {n.e}")
    out = with_headers(records, heads, bands, id_col)
    codes = F.array_distinct(F.array_compact(F.array(*[F.col(f"`{b}_metadata`.epsg") for b in bands])))
    one = F.when(F.size(codes) > 1, F.raise_error(F.lit("bands of one record have different systems")).cast("int")).otherwise(F.get(codes, F.lit(0)))
    old = name("proj:epsg") if "proj:epsg" in out.columns else F.lit(None).cast("int")
    out = out.withColumn("proj:epsg", F.coalesce(old, one))
    return out.withColumn("crs", F.coalesce(name("crs") if "crs" in out.columns else F.lit(None).cast("string"), crs_code_column(name("proj:epsg"))))
