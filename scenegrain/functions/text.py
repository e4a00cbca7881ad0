"""Names, addresses and other texts of records, as plain functions and as column expressions."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short tokens of two well-known sources in collection names.
SHORT_SOURCES = {"sentinel-2-l2a": "sentinel", "landsat-c2-l2": "landsat"}


def _token(text: str, empty: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", text.strip().lower()).strip("-") or empty


def create_name(custom: str, date_range: tuple[str, str], data_source: str) -> str:
    """``{custom}_{YYYYMM-MM or YYYYMM-YYYYMM}_{source}``."""
    a, b = (date.fromisoformat(x[:10]) for x in date_range)
    span = f"{a:%Y%m}-{b:%m}" if a.year == b.year else f"{a:%Y%m}-{b:%Y%m}"
    source = data_source.strip().lower()
    return "_".join([_token(custom, "collection"), span, SHORT_SOURCES.get(source) or _token(source, "source")])


def parse_name(name: str) -> dict[str, str | None]:
    clean = name.replace("_stac", "")
    parts = clean.split("_")
    if len(parts) == 3 and len(parts[1].split("-")) == 2:
        return {"custom_name": parts[0], "data_source": parts[2], "name": clean}
    return {"custom_name": name, "data_source": None, "name": name}


def token_column(c: Column, empty: str) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit(empty)).otherwise(t)


def name_column(custom: Column, start: Column, end: Column, source: Column) -> Column:
    span = F.concat(F.date_format(start, "yyyyMM"), F.lit("-"), F.when(F.year(start) == F.year(end), F.date_format(end, "MM")).otherwise(F.date_format(end, "yyyyMM")))
    src = F.lower(F.trim(source))
    token = token_column(src, "source")
    for k, v in SHORT_SOURCES.items():
        token = F.when(src == k, F.lit(v)).otherwise(token)
    return F.concat_ws("_", token_column(custom, "collection"), span, token)


def rewrite_prefix(url: str, prefixes: dict[str, str]) -> str:
    """The first prefix that fits is replaced, once and at the start."""
    for src, dst in prefixes.items():
        if url.startswith(src):
            return dst + url[len(src) :]
    return url


def rewrite_prefix_column(url: Column, prefixes: dict[str, str]) -> Column:
    out = url
    for src, dst in reversed(list(prefixes.items())):
        out = F.when(F.startswith(url, F.lit(src)), F.concat(F.lit(dst), F.substr(url, F.lit(len(src) + 1)))).otherwise(out)
    return out


# Host patterns of object stores.
S3_HOST = r"^https://([a-z0-9.\-]+)\.s3(?:[.\-]([a-z0-9\-]+))?\.amazonaws\.com/(.+)$"
AZURE_HOST = r"^https://([a-z0-9]+)\.blob\.core\.windows\.net/([^/?]+)/(.*)$"
GCS_HOST = r"^https://storage\.googleapis\.com/([^/?]+)/(.*)$"
SIGNED = r"[?&](?:sig|X-Amz-Signature|X-Goog-Signature)="


def route_url(url: str) -> tuple[str, str]:
    """(store, bucket or host) that serves an address."""
    if url.startswith("s3://"):
        return "s3", url[5:].split("/", 1)[0]
    if url.startswith("gs://"):
        return "gcs", url[5:].split("/", 1)[0]
    if re.search(SIGNED, url):
        return "http", re.match(r"https?://([^/?]+)", url)[1]
    for store, pattern in (("s3", S3_HOST), ("azure", AZURE_HOST), ("gcs", GCS_HOST)):
        if m := re.match(pattern, url):
            return store, m[1]
    if m := re.match(r"https?://([^/?]+)", url):
        return "http", m[1]
    return "local", ""


def route_columns(url: Column) -> tuple[Column, Column]:
    host = F.regexp_extract(url, r"^https?://([^/?]+)", 1)
    plain = ~url.rlike(SIGNED)
    store = F.when(url.startswith("s3://"), "s3").when(url.startswith("gs://"), "gcs").when(plain & url.rlike(S3_HOST), "s3").when(plain & url.rlike(AZURE_HOST), "azure").when(plain & url.rlike(GCS_HOST), "gcs").when(host != "", "http").otherwise("local")
    bucket = F.when(url.rlike("^(s3|gs)://"), F.regexp_extract(url, r"^(?:s3|gs)://([^/]*)", 1)).when(plain & url.rlike(S3_HOST), F.regexp_extract(url, S3_HOST, 1)).when(plain & url.rlike(AZURE_HOST), F.regexp_extract(url, AZURE_HOST, 1)).when(plain & url.rlike(GCS_HOST), F.regexp_extract(url, GCS_HOST, 1)).otherwise(host)
    return store, bucket


HF_URI = r"^hf://datasets/([^/@]+/[^/@]+)(?:@([^/]+))?(?:/(.*))?$"


def parse_hf_uri(uri: str) -> tuple[str, str | None, str]:
    """(dataset, revision, path inside) of ``hf://datasets/org/name[@rev][/sub]``."""
    m = re.match(HF_URI, uri)
    if not m:
        raise ValueError(f"not a dataset address: {uri}")
    return m[1], m[2], (m[3] or "").strip("/")


def nodata_column(text: Column) -> Column:
    """A number from a nodata text: blanks are null, ``nan`` is NaN, other texts are null."""
    return F.trim(text).try_cast("double")
