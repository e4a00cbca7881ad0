"""Geometry input of callers: anything reasonable to WKB, GeoJSON both ways, CRS metadata, coordinate columns."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from scenegrain.functions import crs, wkb

#: Pairs of names under which tables carry coordinates, in order of preference (fixed values).
XY_NAMES = (("x", "y"), ("lon", "lat"), ("longitude", "latitude"), ("lng", "lat"))


class UnsupportedGeometry(ValueError):
    """Neither a Polygon nor a MultiPolygon where one is needed, or a Point where one is."""


def from_geojson(g: dict | str) -> bytes:
    """WKB of a GeoJSON Point, Polygon, MultiPolygon, or of a Feature around one."""
    g = json.loads(g) if isinstance(g, str) else g
    if g.get("type") == "Feature":
        g = g["geometry"]
    kind, c = g.get("type"), g.get("coordinates")
    flat = lambda rings: [[p[:2] for p in r] for r in rings]
    if kind == "Point":
        return wkb.point(*c[:2])
    if kind == "Polygon":
        return wkb.polygon(*flat(c))
    if kind == "MultiPolygon":
        return wkb.multipolygon(*map(flat, c))
    raise UnsupportedGeometry(f"{kind} is not supported")


def to_geojson(b: bytes) -> dict:
    """GeoJSON of a polygonal WKB."""
    p = wkb.parse(b)
    if p is None:
        raise UnsupportedGeometry("no readable Polygon or MultiPolygon")
    parts = [[r.tolist() for r in rings] for rings in p]
    return {"type": "Polygon", "coordinates": parts[0]} if len(parts) == 1 else {"type": "MultiPolygon", "coordinates": parts}


def box(x0: float, y0: float, x1: float, y1: float) -> bytes:
    return wkb.polygon([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)])


def coerce(value) -> list[bytes]:
    """WKB of one or several geometries: bytes, a bbox, GeoJSON (also a FeatureCollection), objects with ``wkb`` or ``__geo_interface__``, Arrow arrays, or a sequence of these."""
    if isinstance(value, (bytes, bytearray, memoryview)):
        return [bytes(value)]
    if isinstance(value, str) or isinstance(value, dict):
        g = json.loads(value) if isinstance(value, str) else value
        return [w for f in g["features"] for w in coerce(f)] if g.get("type") == "FeatureCollection" else [from_geojson(g)]
    if hasattr(value, "wkb"):
        return [bytes(value.wkb)]
    if hasattr(value, "__geo_interface__"):
        return coerce(dict(value.__geo_interface__))
    if hasattr(value, "to_pylist"):
        return [w for v in value.to_pylist() for w in coerce(v)]
    if isinstance(value, Sequence) and len(value) == 4 and all(isinstance(v, (int, float, np.number)) for v in value):
        return [box(*map(float, value))]
    if isinstance(value, Sequence):
        return [w for v in value for w in coerce(v)]
    raise UnsupportedGeometry(f"cannot read a geometry from {type(value).__name__}")


def transform(b: bytes, source: int, target: int) -> bytes:
    """A polygonal WKB in another system."""
    p = wkb.parse(b)
    if p is None:
        raise UnsupportedGeometry("no readable Polygon or MultiPolygon")
    moved = [[np.column_stack(crs.transform(r[:, 0], r[:, 1], source, target)) for r in rings] for rings in p]
    return wkb.polygon(*moved[0]) if len(moved) == 1 else wkb.multipolygon(*moved)


def column_crs(df: DataFrame, column: str = "geometry") -> int | None:
    """EPSG code of a geometry column by its field's metadata (GeoArrow's ``ARROW:extension:metadata``, or ``crs``); None if it has none.

    Edges other than planar ones are an error.
    """
    meta = df.schema[column].metadata or {}
    ext = meta.get("ARROW:extension:metadata") or {}
    ext = json.loads(ext) if isinstance(ext, str) else ext
    if ext.get("edges", "planar") != "planar":
        raise ValueError(f"{ext['edges']} edges are not supported")
    said = ext.get("crs") or meta.get("crs")
    if said in ("OGC:CRS84", "CRS84"):
        return 4326
    return crs.parse_epsg(said)


def geometry_column(df: DataFrame) -> str:
    """The one geometry column: by GeoArrow metadata, else by name."""
    found = [f.name for f in df.schema if str((f.metadata or {}).get("ARROW:extension:name", "")).startswith("geoarrow")]
    found = found or [c for c in ("geometry", "geom", "wkb") if c in df.columns]
    if len(found) != 1:
        raise ValueError("no geometry column" if not found else f"several geometry columns: {found}")
    return found[0]


def xy_columns(columns: Sequence[str], x: str | None = None, y: str | None = None) -> tuple[str, str]:
    """The coordinate columns given, else the first known pair present."""
    if (x is None) != (y is None):
        raise ValueError("give both coordinate columns or none")
    for a, b in [(x, y)] if x else XY_NAMES:
        if a in columns and b in columns:
            return a, b
    raise ValueError(f"no coordinate columns among {list(columns)}")


def fail_on_collisions(own: Sequence[str], reserved: Sequence[str]) -> None:
    clash = sorted(set(own) & set(reserved))
    if clash:
        raise ValueError(f"columns collide with result columns: {clash}")


def random_points(b: bytes, n: int, seed: int = 42) -> np.ndarray:
    """``n`` points uniform in a polygon, by rejection; the same for the same seed."""
    p = wkb.parse(b)
    x0, y0, x1, y1 = wkb.bounds(p)
    e = wkb.edges(p)
    rng, out = np.random.default_rng(seed), np.empty((0, 2))
    while len(out) < n:
        c = rng.uniform((x0, y0), (x1, y1), (max(64, 2 * n), 2))
        up = (e[None, :, 1] > c[:, None, 1]) != (e[None, :, 3] > c[:, None, 1])
        with np.errstate(divide="ignore", invalid="ignore"):
            at = e[None, :, 0] + (c[:, None, 1] - e[None, :, 1]) * (e[None, :, 2] - e[None, :, 0]) / (e[None, :, 3] - e[None, :, 1])
        inside = (up & (c[:, None, 0] < at)).sum(1) % 2 == 1
        out = np.concatenate([out, c[inside]])
    return out[:n]
