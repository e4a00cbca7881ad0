"""STAC items: JSON to rows, filters of an item search, and a crawl of static catalogs."""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenegrain.collection import BBOX
from scenegrain.functions.predicates import bbox_overlaps

ITEM = (
    "id string, collection string, bbox array<double>, geometry string, "
    "properties struct<datetime: string, start_datetime: string, end_datetime: string, `eo:cloud_cover`: double, `proj:epsg`: int, `proj:code`: string>, "
    "assets map<string, struct<href: string, alternate: map<string, struct<href: string>>>>"
)


def items(df: DataFrame, column: str = "value", collection: str = "") -> DataFrame:
    """Rows (id, collection, datetime, bbox, geometry_json, assets, properties flattened) of a column of item JSON; unreadable items have a null id and are left out."""
    j = df.select(F.from_json(column, ITEM).alias("i")).select("i.*").filter("id IS NOT NULL")
    b = F.col("bbox")
    three = F.size(b) == 6
    box = F.when(F.size(b).isin(4, 6), F.struct(b[0].alias("xmin"), b[1].alias("ymin"), F.when(three, F.get(b, F.lit(3))).otherwise(b[2]).alias("xmax"), F.when(three, F.get(b, F.lit(4))).otherwise(F.get(b, F.lit(3))).alias("ymax")).cast(BBOX))
    when = F.to_timestamp_ntz(F.regexp_replace(F.coalesce("properties.datetime", "properties.start_datetime"), "Z$", ""))
    return j.select("id", F.coalesce(F.col("collection"), F.lit(collection or None)).alias("collection"), when.alias("datetime"), box.alias("bbox"), F.col("geometry").alias("geometry_json"), "assets", "properties.eo:cloud_cover", "properties.proj:epsg", "properties.proj:code")


def search(rows: DataFrame, bbox=None, date_range: tuple[str, str] | None = None, max_items: int | None = None) -> DataFrame:
    """What an item search returns: inclusive box and dates, the whole end day included; ``max_items`` in order of time and id."""
    if bbox is not None:
        rows = rows.filter(bbox_overlaps(bbox))
    if date_range is not None:
        rows = rows.filter((F.col("datetime") >= F.lit(date_range[0]).cast("timestamp_ntz")) & (F.col("datetime") <= F.lit(f"{date_range[1][:10]} 23:59:59").cast("timestamp_ntz")))
    return rows.orderBy("datetime", "id").limit(max_items) if max_items else rows


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Newline-separated items, or files of one item or one ItemCollection each."""
    text = spark.read.text(path, wholetext=not path.endswith((".ndjson", ".jsonl")))
    many = F.from_json("value", "struct<type: string, features: array<variant>>")
    t = text.withColumn("c", many)
    single = t.filter("c.features IS NULL").select("value")
    return items(single.unionByName(t.filter("c.features IS NOT NULL").select(F.explode("c.features").alias("f")).select(F.to_json("f").alias("value"))))


def crawl(root: str) -> Iterator[str]:
    """Item files under a static catalog on a shared file system, by its child and item links."""
    todo, seen = [os.path.abspath(root)], set()
    while todo:
        at = todo.pop()
        if at in seen:
            continue
        seen.add(at)
        with open(at) as f:
            doc = json.load(f)
        if doc.get("type") == "Feature":
            yield at
        todo += [os.path.normpath(os.path.join(os.path.dirname(at), l["href"])) for l in reversed(doc.get("links", [])) if l.get("rel") in ("child", "item")]


def with_retries(call: Callable, attempts: int = 3, wait: Callable[[float], None] = time.sleep):
    """Call again after 1 s, then 2 s, if the error looks temporary."""
    for k in range(attempts):
        try:
            return call()
        except Exception as e:
            temporary = any(x in str(e).lower() for x in ("408", "429", "500", "502", "503", "504", "timeout", "timed out"))
            if not temporary or k == attempts - 1:
                raise
            wait(2.0**k)


def search_service(api: str, query: dict, limit: int = 250, opener=None) -> list[dict]:
    """All items of a search, page by page along the ``next`` links (POST or GET). The items of one search are the driver's; part large searches by time."""
    opener = opener or urllib.request.urlopen
    url, body, out = api.rstrip("/") + "/search", dict(query, limit=limit), []
    while url:
        data = None if body is None else json.dumps(body).encode()
        with opener(urllib.request.Request(url, data=data, headers={"Content-Type": "application/json"}), timeout=60) as r:
            page = json.loads(r.read())
        out += page.get("features", [])
        link = next((x for x in page.get("links", []) if x.get("rel") == "next"), None)
        url = link and link["href"]
        if link:
            more = link.get("body")
            body = ({**body, **more} if link.get("merge") else more) if str(link.get("method", "GET")).upper() == "POST" else None
    return out
