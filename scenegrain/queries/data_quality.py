"""Queries of the general data operators: schema drift, spatial neighbours, quality profile, timestamps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenegrain.operators import quality_profile, schema_drift, spatial, timestamps


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    flat = schema_drift.flatten(spark.read.parquet(f"{d}/header_lines.parquet"))
    return schema_drift.changes(schema_drift.migrations(schema_drift.fingerprints(flat))).select("file_id", "field", "change").distinct()


def p1_migrations(spark: SparkSession, d: str) -> DataFrame:
    """Each file's version in its stream and the rules of the version."""
    m = schema_drift.migrations(schema_drift.fingerprints(schema_drift.flatten(spark.read.parquet(f"{d}/header_lines.parquet"))))
    return m.select("file_id", "stream", "version", "starts", F.to_json("rules").alias("rules"))


def p1_unified(spark: SparkSession, d: str) -> DataFrame:
    """All lines in one table with one column and type per field."""
    flat = schema_drift.flatten(spark.read.parquet(f"{d}/header_lines.parquet"))
    u = schema_drift.unify(flat, schema_drift.migrations(schema_drift.fingerprints(flat)))
    return u.select("file_id", "line_no", "readable", "nodata", "samples_per_pixel", "photometric", F.array_join("extra_samples", ",").alias("extra_samples"))


_PATHS = {
    "nodata": ("nodata", "GDAL_NODATA", "no_data", "nodata_value", "gdal.nodata", "NoData", "noDataValue", "tags.42113"),
    "samples_per_pixel": ("samples_per_pixel", "layout.samples_per_pixel", "tags.277", "samples-per-pixel", "spp", "SamplesPerPixel", "samplesPerPixel"),
    "photometric": ("photometric", "photometric_interpretation", "color.photometric", "tags.262", "PhotometricInterpretation", "Photometric"),
    "extra_samples": ("extra_samples", "extrasamples", "ExtraSamples", "layout.extra_samples", "extraSamples", "tags.338"),
}
_VALUES = ", ".join("('{}', '{}', '$.{}')".format(f, p, ".".join(f'"{x}"' for x in p.split("."))) for f, ps in _PATHS.items() for p in ps)
P1_SQL = f"""
WITH keys(field, path, jpath) AS (VALUES {_VALUES}),
lines AS (SELECT DISTINCT file_id, stream, written_at, line_no, payload FROM header_lines WHERE json_valid(payload)),
files AS (SELECT DISTINCT file_id, stream, written_at FROM header_lines),
hits AS (SELECT file_id, field, path, json_type(payload, jpath) AS t FROM lines, keys WHERE json_type(payload, jpath) IS NOT NULL),
kinds AS (
  SELECT file_id, field, CASE WHEN t IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT', 'UHUGEINT') THEN 'number' WHEN t = 'VARCHAR' THEN 'string' WHEN t = 'ARRAY' THEN 'array' ELSE lower(t) END AS kind, count(*) AS n
  FROM hits WHERE t <> 'NULL' GROUP BY ALL
),
kind1 AS (SELECT file_id, field, kind FROM kinds QUALIFY row_number() OVER (PARTITION BY file_id, field ORDER BY n DESC, kind) = 1),
path1 AS (SELECT file_id, field, path FROM (SELECT file_id, field, path, count(*) AS n FROM hits GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY file_id, field ORDER BY n DESC, path) = 1),
state AS (
  SELECT f.file_id, f.stream, f.written_at, k.field, p.path, q.kind
  FROM files f CROSS JOIN (SELECT DISTINCT field FROM keys) k LEFT JOIN path1 p USING (file_id, field) LEFT JOIN kind1 q USING (file_id, field)
),
seq AS (
  SELECT *, lag(path) OVER w AS path0, lag(kind) OVER w AS kind0, row_number() OVER w AS k FROM state
  WINDOW w AS (PARTITION BY stream, field ORDER BY written_at, file_id)
)
SELECT file_id, field, 'added' AS change FROM seq WHERE k > 1 AND path IS NOT NULL AND path0 IS NULL
UNION ALL SELECT file_id, field, 'removed' FROM seq WHERE k > 1 AND path IS NULL AND path0 IS NOT NULL
UNION ALL SELECT file_id, field, 'renamed' FROM seq WHERE k > 1 AND path <> path0
UNION ALL SELECT file_id, field, 'retyped' FROM seq WHERE k > 1 AND path IS NOT NULL AND path0 IS NOT NULL AND kind <> kind0
"""

_WORDS = {"miniswhite": 0, "minisblack": 1, "rgb": 2, "palette": 3, "mask": 4, "cmyk": 5, "separated": 5, "ycbcr": 6, "cielab": 8}
P1_UNIFIED_SQL = f"""
WITH keys(field, path, jpath) AS (VALUES {_VALUES}),
lines AS (SELECT *, row_number() OVER () AS k, coalesce(json_type(CASE WHEN json_valid(payload) THEN payload END) = 'OBJECT', FALSE) AS readable FROM header_lines),
whole AS (SELECT k, CASE WHEN readable THEN payload END AS payload FROM lines),
hits AS (SELECT k, field, json_extract_string(payload, jpath) AS t, row_number() OVER (PARTITION BY k, field ORDER BY length(path) - length(replace(path, '.', '')), path) AS r FROM whole, keys WHERE json_type(payload, jpath) IS NOT NULL),
wide AS (
  SELECT k, trim(max(t) FILTER (field = 'nodata')) AS nodata, trim(max(t) FILTER (field = 'samples_per_pixel')) AS spp, trim(max(t) FILTER (field = 'photometric')) AS photo,
         regexp_replace(max(t) FILTER (field = 'extra_samples'), '[\\[\\]\\s"]', '', 'g') AS extra
  FROM hits WHERE r = 1 GROUP BY k
)
SELECT file_id, line_no, readable, TRY_CAST(nodata AS DOUBLE) AS nodata, CAST(trunc(TRY_CAST(spp AS DOUBLE)) AS INTEGER) AS samples_per_pixel,
       coalesce(CAST(trunc(TRY_CAST(photo AS DOUBLE)) AS INTEGER), CASE lower(regexp_replace(photo, '[^A-Za-z]', '', 'g')) {" ".join(f"WHEN '{w}' THEN {n}" for w, n in _WORDS.items())} END) AS photometric,
       array_to_string(list_transform(list_filter(string_split(extra, ','), lambda x: x <> ''), lambda x: CAST(trunc(TRY_CAST(x AS DOUBLE)) AS INTEGER)), ',') AS extra_samples
FROM lines LEFT JOIN wide USING (k)
"""


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return spatial.neighbours(spark.read.parquet(f"{d}/points.parquet"), spark.read.parquet(f"{d}/records.parquet"), 250.0)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return quality_profile.issues(quality_profile.profile(spark.read.parquet(f"{d}/records.parquet"), quality_profile.RECORD_RULES))


def p4_profile(spark: SparkSession, d: str) -> DataFrame:
    """The profile itself: one row per load and column."""
    p = quality_profile.profile(spark.read.parquet(f"{d}/records.parquet"), quality_profile.RECORD_RULES)
    return p.select("load_id", "column_name", "rows", "nulls", "distinct", F.round("outside_share", 9).alias("outside_share"), F.round("nonconforming_share", 9).alias("nonconforming_share"), F.round("top_share", 9).alias("top_share"), F.round("median", 6).alias("median"))


def p4_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The expressions of ``crs`` by load, and how far their coverage is from the usual."""
    crs = next(r for r in quality_profile.RECORD_RULES if r.pattern)
    return quality_profile.coverage_changes(quality_profile.coverage(spark.read.parquet(f"{d}/records.parquet"), crs))


_CC = '"eo:cloud_cover"'
_P4_STATS = f"""
WITH per AS (
  SELECT load_id, 'eo:cloud_cover' AS column_name, CASE WHEN isnan({_CC}) THEN NULL ELSE CAST({_CC} AS VARCHAR) END AS v,
         coalesce({_CC} BETWEEN 0 AND 100, TRUE) AS ok, TRUE AS fits, CASE WHEN {_CC} BETWEEN 0 AND 100 THEN {_CC} END AS num FROM records
  UNION ALL SELECT load_id, 'datetime', CAST(datetime AS VARCHAR), coalesce(datetime >= TIMESTAMP '1984-01-01' AND (ingested_at IS NULL OR datetime <= ingested_at), TRUE), TRUE, NULL FROM records
  UNION ALL SELECT load_id, 'crs', crs, TRUE, coalesce(regexp_full_match(crs, 'EPSG:[0-9]{{4,5}}'), TRUE), NULL FROM records
),
stats AS (
  SELECT load_id, column_name, count(*) AS n, count(v) AS filled, count(*) FILTER (v IS NOT NULL AND NOT ok) AS outside, count(*) FILTER (v IS NOT NULL AND NOT fits) AS odd, median(num) AS med FROM per GROUP BY ALL
),
tops AS (SELECT load_id, column_name, max(k) AS top, count(*) AS kinds FROM (SELECT load_id, column_name, v, count(*) AS k FROM per WHERE v IS NOT NULL GROUP BY ALL) GROUP BY ALL),
shares AS (SELECT *, 1 - filled / n AS null_share FROM stats LEFT JOIN tops USING (load_id, column_name)),
"""
P4_PROFILE_SQL = f"""
{_P4_STATS.rstrip().rstrip(",")}
SELECT load_id, column_name, n AS rows, n - filled AS nulls, coalesce(kinds, 0) AS "distinct", CASE WHEN filled > 0 THEN round(outside / filled, 9) END AS outside_share, CASE WHEN filled > 0 THEN round(odd / filled, 9) END AS nonconforming_share, CASE WHEN filled > 0 THEN round(top / filled, 9) END AS top_share, round(med, 6) AS median FROM shares
"""
P4_SQL = f"""
{_P4_STATS}
usual AS (SELECT column_name, median(null_share) AS un, median(med) AS um FROM shares GROUP BY ALL),
j AS (SELECT * FROM shares JOIN usual USING (column_name))
SELECT load_id, column_name, 'nulls' AS issue FROM j WHERE abs(null_share - un) > 0.15
UNION ALL SELECT load_id, column_name, 'range' FROM j WHERE filled > 0 AND outside / filled > 0.06
UNION ALL SELECT load_id, column_name, 'pattern' FROM j WHERE filled > 0 AND odd / filled > 0.06
UNION ALL SELECT load_id, column_name, 'shift' FROM j WHERE abs(med - um) > 15
UNION ALL SELECT load_id, column_name, 'constant' FROM j WHERE filled > 0 AND top / filled > 0.5
"""


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    n = timestamps.with_estimates(timestamps.normalise(spark.read.parquet(f"{d}/raw_items.parquet"), spark.read.parquet(f"{d}/feeds.parquet")))
    # an estimated instant is not known to be the one
    return n.filter("how <> 'estimated'").select("item_no", F.col("instant_us").alias("utc_us")).distinct()


def p5_statuses(spark: SparkSession, d: str) -> DataFrame:
    """How every item came out, with estimates where the zone is unknown."""
    n = timestamps.with_estimates(timestamps.normalise(spark.read.parquet(f"{d}/raw_items.parquet"), spark.read.parquet(f"{d}/feeds.parquet")))
    return n.select("item_no", "status", "zone_source", "utc_us", "estimated_us")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (p1_found, p1_unified, p1_migrations, p2_found, p4_found, p4_profile, p4_coverage, p5_found, p5_statuses)}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL, "p1_unified": P1_UNIFIED_SQL, "p4_found": P4_SQL, "p4_profile": P4_PROFILE_SQL}
