"""Well-known-binary footprints as plain coordinate arrays.

``parse`` is total: whatever bytes arrive, it answers with a list of polygons
(each a list of rings, each an ``(n, 2)`` float array) or ``None`` where the
bytes are missing, empty or no readable polygonal geometry.
"""

from __future__ import annotations

import struct

import numpy as np

POINT, LINESTRING, POLYGON, MULTIPOINT, MULTILINESTRING, MULTIPOLYGON, COLLECTION = range(1, 8)
TYPE_NAMES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}


class _Reader:
    __slots__ = ("at", "buf")

    def __init__(self, buf: bytes):
        self.buf, self.at = buf, 0

    def head(self) -> tuple[str, int, int]:
        """Byte order mark, base type and coordinates per position."""
        order = self.buf[self.at]
        if order not in (0, 1):
            raise ValueError("byte order")
        mark = "<" if order else ">"
        (code,) = struct.unpack_from(mark + "I", self.buf, self.at + 1)
        self.at += 5
        dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
        if code & 0x20000000:  # an SRID follows
            self.at += 4
        code &= 0x0FFFFFFF
        if code >= 1000:
            dims, code = {1: 3, 2: 3, 3: 4}[code // 1000], code % 1000
        return mark, code, dims

    def count(self, mark: str) -> int:
        (n,) = struct.unpack_from(mark + "I", self.buf, self.at)
        self.at += 4
        return n

    def coords(self, mark: str, n: int, dims: int) -> np.ndarray:
        size = n * dims * 8
        if self.at + size > len(self.buf):
            raise ValueError("cut off")
        out = np.frombuffer(self.buf, mark + "f8", n * dims, self.at).reshape(n, dims)[:, :2].astype("f8")
        self.at += size
        return out

    def polygon(self, mark: str, dims: int) -> list[np.ndarray]:
        return [self.coords(mark, self.count(mark), dims) for _ in range(self.count(mark))]


def parse(buf: bytes | None) -> list[list[np.ndarray]] | None:
    """Polygons of a WKB Polygon, MultiPolygon or collection of these; None if there is none to read."""
    if not buf:
        return None
    try:
        r = _Reader(bytes(buf))
        out = _polygons(r)
        if r.at != len(r.buf):
            return None
    except (ValueError, IndexError, KeyError, struct.error):
        return None
    kept = []
    for rings in out:
        if not rings or len(rings[0]) < 4:
            continue
        if not all(np.isfinite(x).all() for x in rings):
            return None
        kept.append([x for x in rings if len(x) >= 4])
    return kept or None


def _polygons(r: _Reader) -> list[list[np.ndarray]]:
    mark, code, dims = r.head()
    if code == POLYGON:
        return [r.polygon(mark, dims)]
    if code in (MULTIPOLYGON, COLLECTION):
        return [p for _ in range(r.count(mark)) for p in _polygons(r)]
    raise ValueError("not polygonal")


def parse_point(buf: bytes | None) -> tuple[float, float] | None:
    if not buf:
        return None
    try:
        r = _Reader(bytes(buf))
        mark, code, dims = r.head()
        if code != POINT:
            return None
        x, y = r.coords(mark, 1, dims)[0]
        return float(x), float(y)
    except (ValueError, IndexError, KeyError, struct.error):
        return None


def point(x: float, y: float) -> bytes:
    return struct.pack("<BIdd", 1, POINT, x, y)


def polygon(*rings) -> bytes:
    out = [struct.pack("<BII", 1, POLYGON, len(rings))]
    for ring in rings:
        xy = np.asarray(ring, "<f8")
        out += [struct.pack("<I", len(xy)), xy.tobytes()]
    return b"".join(out)


def multipolygon(*polygons) -> bytes:
    return struct.pack("<BII", 1, MULTIPOLYGON, len(polygons)) + b"".join(polygon(*p) for p in polygons)


def bounds(polygons: list[list[np.ndarray]]) -> tuple[float, float, float, float]:
    every = np.concatenate([rings[0] for rings in polygons])
    (x0, y0), (x1, y1) = every.min(0), every.max(0)
    return float(x0), float(y0), float(x1), float(y1)


def edges(polygons: list[list[np.ndarray]]) -> np.ndarray:
    """Edges of all rings as rows (x0, y0, x1, y1); rings left open are closed; edges without length are left out."""
    parts = []
    for rings in polygons:
        for ring in rings:
            nxt = np.roll(ring, -1, axis=0)
            e = np.hstack([ring, nxt])
            parts.append(e[(ring != nxt).any(axis=1)])
    return np.concatenate(parts)
