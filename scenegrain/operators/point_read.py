"""Points of a file: the tiles in reach are decoded a few at a time, sampled and let go."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from scenegrain.functions import crs
from scenegrain.operators import raster_read
from scenegrain.operators.tiles import ring_offsets, square_offsets
from scenegrain.sources.bytes import ByteSource
from scenegrain.tiff.header import Header

#: Tiles that are read at once, at most; with a window, those in its reach come on top.
AT_ONCE = 32


@dataclass
class Sampled:
    """Of the points in order: ``hit`` (has a row), value, error, window; and the tiles read and failed."""

    hit: np.ndarray
    value: np.ndarray
    error: list[str | None]
    window: list[np.ndarray | None]
    read: int
    failed: dict[tuple[int, int], str]


def place(h: Header, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and column of lon/lat points in a raster, with fractions, and the raster's system; unknown systems raise."""
    epsg = h.epsg or 4326
    x, y = (lon, lat) if epsg == 4326 else crs.transform(lon, lat, 4326, epsg)
    sx, tx, sy, ty = h.transform
    return (y - ty) / sy, (x - tx) / sx, epsg


def _tiles(source: ByteSource, url: str, h: Header, index: int, wanted: list[tuple[int, int]]) -> tuple[dict, dict]:
    """Decoded tiles, with near byte ranges merged; if that fails, each is tried by itself. And the failures."""
    try:
        return raster_read.read_tiles(source, url, h, index, wanted), {}
    except Exception:
        got, failed = {}, {}
        for t in wanted:
            try:
                got |= raster_read.read_tiles(source, url, h, index, [t])
            except Exception as e:
                failed[t] = f"{type(e).__name__}: {e}"[:200]
        return got, failed


def _nodata(v: np.ndarray, nodata: float | None) -> np.ndarray:
    return np.isnan(v) if nodata is None else np.isnan(v) | (v == nodata)


def sample(source: ByteSource, url: str, h: Header, index: int, lon: np.ndarray, lat: np.ndarray, reach: int = 0, neighbourhood: str = "off") -> Sampled:
    """Sample a band at points (see ``read.sample_points``). Tiles are taken in order, so that each is read once unless a window straddles a border."""
    rf, cf, _ = place(h, lon, lat)
    n = len(lon)
    out = Sampled(np.zeros(n, bool), np.full(n, np.nan), [None] * n, [None] * n, 0, {})
    with np.errstate(invalid="ignore"):
        ok = np.isfinite(rf) & np.isfinite(cf) & (rf >= 0) & (cf >= 0) & (rf < h.height) & (cf < h.width)
    at = np.flatnonzero(ok)
    row, col = np.floor(rf[at]).astype("i8"), np.floor(cf[at]).astype("i8")
    th, tw = h.tile_height, h.tile_width
    across = -(-h.width // tw)
    home = row // th * across + col // tw
    order = np.argsort(home, kind="stable")
    homes, first = np.unique(home[order], return_index=True)
    ends = np.append(first[1:], len(order))
    cache: dict[tuple[int, int], np.ndarray | None] = {}
    for k in range(0, len(homes), AT_ONCE):
        spans = []
        for t, a, b in zip(homes[k : k + AT_ONCE].tolist(), first[k : k + AT_ONCE], ends[k : k + AT_ONCE]):
            who = order[a:b]
            lo = max(int(row[who].min()) - reach, 0) // th, max(int(col[who].min()) - reach, 0) // tw
            hi = min(int(row[who].max()) + reach, h.height - 1) // th, min(int(col[who].max()) + reach, h.width - 1) // tw
            spans.append((divmod(t, across), who, lo, hi))
        wanted = dict.fromkeys((i, j) for _, _, lo, hi in spans for i in range(lo[0], hi[0] + 1) for j in range(lo[1], hi[1] + 1))
        cache = {t: v for t, v in cache.items() if t in wanted}
        new = [t for t in wanted if t not in cache and t not in out.failed]
        got, failed = _tiles(source, url, h, index, new)
        out.read += len(new) - len(failed)
        out.failed |= failed
        cache |= {t: got.get(t) for t in new if t not in failed}
        for t, who, lo, hi in spans:
            _sample_tile(out, cache, h, t, lo, hi, at[who], row[who], col[who], rf[at[who]], cf[at[who]], reach, neighbourhood)
    return out


def _sample_tile(out: Sampled, cache: dict, h: Header, home: tuple[int, int], lo, hi, points: np.ndarray, row: np.ndarray, col: np.ndarray, rf: np.ndarray, cf: np.ndarray, reach: int, neighbourhood: str) -> None:
    if home in out.failed:
        for i in points.tolist():
            out.error[i] = out.failed[home]
        return
    if cache.get(home) is None:  # a tile without bytes
        return
    th, tw = h.tile_height, h.tile_width
    out.hit[points] = True
    if not reach:
        out.value[points] = cache[home][row - home[0] * th, col - home[1] * tw]
        return
    r0, c0 = lo[0] * th, lo[1] * tw
    canvas = np.full(((hi[0] - lo[0] + 1) * th, (hi[1] - lo[1] + 1) * tw), np.nan)
    bad = []
    for i in range(lo[0], hi[0] + 1):
        for j in range(lo[1], hi[1] + 1):
            tile = cache.get((i, j))
            if tile is not None:
                canvas[i * th - r0 : (i + 1) * th - r0, j * tw - c0 : (j + 1) * tw - c0] = tile
            elif (i, j) in out.failed:
                bad.append((i, j))
    value = canvas[row - r0, col - c0]
    empty = _nodata(value, h.nodata)

    def look(who: np.ndarray, offsets: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values of the points' pixels at offsets, NaN outside the raster or unread, and these pixels."""
        d = np.array(offsets)
        r, c = row[who][:, None] + d[:, 0], col[who][:, None] + d[:, 1]
        inside = (r >= 0) & (c >= 0) & (r < h.height) & (c < h.width)
        v = np.where(inside, canvas[np.clip(r - r0, 0, canvas.shape[0] - 1), np.clip(c - c0, 0, canvas.shape[1] - 1)], np.nan)
        return v, r, c

    if neighbourhood != "off":
        which = np.arange(len(points)) if neighbourhood == "always" else np.flatnonzero(empty)
        for a in range(0, len(which), 4096):
            who = which[a : a + 4096]
            for i, v in zip(points[who].tolist(), look(who, square_offsets(reach))[0] if len(who) else ()):
                out.window[i] = v
    # the lost tiles matter where the fallback or the window had to look for them
    for i, j in bad:
        near = (row + reach >= i * th) & (row - reach < (i + 1) * th) & (col + reach >= j * tw) & (col - reach < (j + 1) * tw)
        for k in np.flatnonzero(near & (True if neighbourhood == "always" else empty)).tolist():
            e = out.error[points[k]]
            out.error[points[k]] = min(e, out.failed[i, j]) if e else out.failed[i, j]
    todo = np.flatnonzero(empty)
    for radius in range(1, reach + 1):
        if not len(todo):
            break
        left = []
        for a in range(0, len(todo), 4096):
            who = todo[a : a + 4096]
            v, r, c = look(who, ring_offsets(radius))
            gap = lambda p, f: np.maximum(np.maximum(p - f[:, None], f[:, None] - p - 1), 0.0)
            d = (gap(r, rf[who]) * abs(h.transform[2])) ** 2 + (gap(c, cf[who]) * abs(h.transform[0])) ** 2
            d[_nodata(v, h.nodata)] = np.inf
            best = d.argmin(axis=1)
            found = np.isfinite(d[np.arange(len(who)), best])
            value[who[found]] = v[np.flatnonzero(found), best[found]]
            left.append(who[~found])
        todo = np.concatenate(left)
    out.value[points] = value
