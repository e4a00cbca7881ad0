"""Reading pixels of files: one task per group of records, ranges merged per file, polygons masked, errors as data."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenegrain.functions import crs, wkb
from scenegrain.session import spread
from scenegrain.sources.bytes import ByteSource, default_source
from scenegrain.tiff import decode
from scenegrain.tiff.header import Header, parse


def merge(ranges: Sequence[tuple[int, int]], gap: int = 1024) -> list[tuple[int, int]]:
    """(start, stop) ranges joined where the gap is at most ``gap``."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + gap:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def read_tiles(source: ByteSource, url: str, h: Header, index: int | None, wanted: Sequence[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
    """Decoded tiles of one band by (row, column); empty tiles (no bytes) are left out."""
    offsets, sizes = decode.plane_tables(h, index or 0)
    if len(offsets) != len(sizes):
        raise ValueError("tile tables differ in length")
    across = -(-h.width // h.tile_width)
    spans = {}
    for t in dict.fromkeys(wanted):
        k = t[0] * across + t[1]
        if k >= len(offsets):
            raise ValueError(f"tile {t} is beyond the tile table")
        if sizes[k]:
            spans[t] = (offsets[k], offsets[k] + sizes[k])
    whole = merge(list(spans.values()))
    blocks = source.get_ranges(url, [(a, b - a) for a, b in whole])
    out = {}
    starts = [a for a, _ in whole]
    for t, (a, b) in spans.items():
        i = int(np.searchsorted(starts, a, side="right")) - 1
        piece = blocks[i][a - starts[i] : b - starts[i]]
        if len(piece) < b - a:
            raise OSError(f"short read of {url}")
        out[t] = decode.band(decode.tile(piece, h), index if h.planar == 1 else None)
    return out


def polygon_mask(polygons, transform, row0: int, col0: int, shape: tuple[int, int], all_touched: bool = False) -> np.ndarray:
    """Pixels whose centre lies in the polygon; with ``all_touched`` also those an edge passes through."""
    sx, tx, sy, ty = transform
    rows, cols = shape
    y = ty + (row0 + np.arange(rows) + 0.5) * sy
    x = tx + (col0 + np.arange(cols) + 0.5) * sx
    e = wkb.edges(polygons)
    out = np.zeros(shape, bool)
    for r in range(rows):
        cross = e[(e[:, 1] > y[r]) != (e[:, 3] > y[r])]
        at = np.sort(cross[:, 0] + (y[r] - cross[:, 1]) * (cross[:, 2] - cross[:, 0]) / (cross[:, 3] - cross[:, 1]))
        out[r] = np.searchsorted(at, x, side="right") % 2 == 1
    if all_touched:
        px = np.column_stack([(e[:, 0] - tx) / sx - col0, (e[:, 1] - ty) / sy - row0, (e[:, 2] - tx) / sx - col0, (e[:, 3] - ty) / sy - row0])
        for x0, y0, x1, y1 in px:
            lo, hi = sorted((y0, y1))
            for r in range(max(0, math.floor(lo)), min(rows - 1, math.floor(hi)) + 1):
                if y0 == y1:
                    a, b = sorted((x0, x1))
                else:
                    u = [np.clip((v - y0) / (y1 - y0), 0, 1) for v in (r, r + 1)]
                    a, b = sorted((x0 + u[0] * (x1 - x0), x0 + u[1] * (x1 - x0)))
                c0, c1 = max(0, math.floor(a)), min(cols - 1, math.floor(b))
                if c0 <= c1:
                    out[r, c0 : c1 + 1] = True
    return out


def read_area(source: ByteSource, url: str, h: Header, index: int | None, polygons, *, mode: str = "aoi", all_touched: bool = False, fill: float | None = None, masked: bool = True) -> dict | None:
    """Pixels of a file under a polygon in its own coordinates; None if they don't meet.

    ``aoi``: the polygon's window, masked. ``window``: the same window, boundless, filled outside the raster.
    ``full``: the whole raster. The result has data, valid, transform and the fill that was used.
    """
    sx, tx, sy, ty = h.transform
    if mode == "full":
        r0, r1, c0, c1 = 0, h.height, 0, h.width
    else:
        x0, y0, x1, y1 = wkb.bounds(polygons)
        cs, rs = sorted(((x0 - tx) / sx, (x1 - tx) / sx)), sorted(((y0 - ty) / sy, (y1 - ty) / sy))
        c0, c1, r0, r1 = math.floor(cs[0]), math.ceil(cs[1]), math.floor(rs[0]), math.ceil(rs[1])
        if mode == "aoi":
            r0, c0, r1, c1 = max(r0, 0), max(c0, 0), min(r1, h.height), min(c1, h.width)
    if r0 >= r1 or c0 >= c1:
        return None
    used = fill if fill is not None else h.nodata if h.nodata is not None else 0
    dtype = np.dtype(h.dtype)
    out = np.full((r1 - r0, c1 - c0), used if dtype.kind == "f" or np.isfinite(used) else 0, dtype)
    valid = np.zeros(out.shape, bool)
    th, tw = h.tile_height, h.tile_width
    ra, rb, ca, cb = max(r0, 0), min(r1, h.height), max(c0, 0), min(c1, h.width)
    if ra < rb and ca < cb:
        wanted = [(i, j) for i in range(ra // th, (rb - 1) // th + 1) for j in range(ca // tw, (cb - 1) // tw + 1)]
        for (i, j), t in read_tiles(source, url, h, index, wanted).items():
            a, b, c, d = max(ra, i * th), min(rb, (i + 1) * th), max(ca, j * tw), min(cb, (j + 1) * tw)
            out[a - r0 : b - r0, c - c0 : d - c0] = t[a - i * th : b - i * th, c - j * tw : d - j * tw]
            valid[a - r0 : b - r0, c - c0 : d - c0] = True
    if masked and mode == "aoi":
        inside = polygon_mask(polygons, h.transform, r0, c0, out.shape, all_touched)
        out[~inside] = used if dtype.kind == "f" or np.isfinite(used) else 0
        valid &= inside
    if h.nodata is not None:
        valid &= ~np.isnan(out) if dtype.kind == "f" and np.isnan(h.nodata) else out != h.nodata
    if dtype.kind == "f":
        valid &= ~np.isnan(out)
    return {"data": out, "valid": valid, "transform": (sx, tx + c0 * sx, sy, ty + r0 * sy), "fill": float(used)}


def reproject(data: np.ndarray, transform, source_epsg: int, target_epsg: int, grid=None, method: str = "bilinear"):
    """Onto a target grid by inverse mapping, outside NaN; integers become float32. Not bit-equal to any warper."""
    from scenegrain.functions.affine import suggested_grid

    t, height, width = grid or suggested_grid(data.shape[1], data.shape[0], transform, source_epsg, target_epsg)
    sx, tx, sy, ty = t
    gx, gy = np.meshgrid(tx + (np.arange(width) + 0.5) * sx, ty + (np.arange(height) + 0.5) * sy)
    x, y = crs.transform(gx, gy, target_epsg, source_epsg)
    c, r = (x - transform[1]) / transform[0] - 0.5, (y - transform[3]) / transform[2] - 0.5
    a = data.astype("f8" if data.dtype == np.float64 else "f4")
    inside = (c >= -0.5) & (r >= -0.5) & (c <= data.shape[1] - 0.5) & (r <= data.shape[0] - 0.5)
    if method == "nearest":
        i, j = (np.clip(np.floor(v + 0.5), 0, n - 1).astype(int) for v, n in ((r, data.shape[0]), (c, data.shape[1])))
        out = a[i, j]
    else:
        i, j = (np.clip(np.floor(v), 0, max(n - 2, 0)).astype(int) for v, n in ((r, data.shape[0]), (c, data.shape[1])))
        u, v = np.clip(r - i, 0, 1), np.clip(c - j, 0, 1)
        i1, j1 = np.minimum(i + 1, data.shape[0] - 1), np.minimum(j + 1, data.shape[1] - 1)
        out = a[i, j] * (1 - u) * (1 - v) + a[i1, j] * u * (1 - v) + a[i, j1] * (1 - u) * v + a[i1, j1] * u * v
    return np.where(inside, out, np.nan).astype(a.dtype), t


def regridded(got: dict, source_epsg: int, target_epsg: int, res: float, method: str = "nearest") -> dict:
    """A window of ``read_area`` on a grid of another system whose lines are multiples of ``res``; its invalid pixels stay invalid."""
    sx, tx, sy, ty = got["transform"]
    h, w = got["data"].shape
    box = (min(tx, tx + w * sx), min(ty, ty + h * sy), max(tx, tx + w * sx), max(ty, ty + h * sy))
    x0, y0, x1, y1 = box if source_epsg == target_epsg else crs.transform_bbox(box, source_epsg, target_epsg)
    c0, r0, c1, r1 = math.floor(x0 / res + 1e-9), math.floor(y0 / res + 1e-9), math.ceil(x1 / res - 1e-9), math.ceil(y1 / res - 1e-9)
    grid = ((res, c0 * res, -res, r1 * res), max(1, r1 - r0), max(1, c1 - c0))
    a, t = reproject(np.where(got["valid"], got["data"], np.nan).astype("f8"), got["transform"], source_epsg, target_epsg, grid, method)
    valid = ~np.isnan(a)
    fill = got["fill"]
    return {"data": np.where(valid, a, fill), "valid": valid, "transform": t, "fill": fill}


def shapes(mask: np.ndarray, labels: bool = False) -> list[tuple[int, int, int, int, int]] | np.ndarray:
    """Connected areas of a mask (edges touch): (pixels, row0, col0, row1, col1) each, by their first pixel; or the number of each pixel's area from 1."""
    label = np.zeros(mask.shape, int)
    out = []
    for r, c in zip(*np.nonzero(mask)):
        if label[r, c]:
            continue
        k, todo, cells = len(out) + 1, [(r, c)], []
        label[r, c] = k
        while todo:
            i, j = todo.pop()
            cells.append((i, j))
            for a, b in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)):
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not label[a, b]:
                    label[a, b] = k
                    todo.append((a, b))
        rs, cs = [x for x, _ in cells], [x for _, x in cells]
        out.append((len(cells), min(rs), min(cs), max(rs), max(cs)))
    return label if labels else out


FRAME = "record string, geometry_id long, band string, height int, width int, dtype string, data binary, valid binary, transform array<double>, fill double, error string"


def read_frame(requests: DataFrame, source: ByteSource | None = None, partitions: int | None = None, transform_fn: Callable[[np.ndarray], np.ndarray] | None = None, to: tuple[int, float] | None = None, method: str = "nearest", **kw) -> DataFrame:
    """One row per request (record, geometry_id, band, href, band_index, geometry, geometry_epsg): the pixels as bytes with their dtype, or an ``error``.

    Requests for one file go to one task (of as many as the session shuffles to, unless ``partitions`` says otherwise), so its header is read
    once, or not at all where the request has it (``head``, JSON); nothing raises inside a task. ``to``: (EPSG code, resolution) of a grid, whose lines
    are multiples of the resolution, that windows are brought onto by ``method``, so that those of different systems fit each other.
    """
    source = source or default_source()
    src = requests if "head" in requests.columns else requests.withColumn("head", F.lit(None).cast("string"))
    src = src.select("record", "geometry_id", "band", "href", "band_index", "geometry", "geometry_epsg", "head")
    src = (src.repartition(partitions, "href") if partitions else spread(src, "href")).sortWithinPartitions("href")

    def batch(rows):
        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
        schema = pa.schema([(f.split(" ")[0], kinds[f.split(" ")[1]]) for f in FRAME.split(", ")])
        return pa.Table.from_pylist(rows, schema=schema).combine_chunks().to_batches()

    def run(batches):
        heads: dict[str, Header] = {}
        for b in batches:
            rows, held = [], 0
            for q in b.to_pylist():
                if held > 1 << 26:  # a batch of windows of any size goes out in parts
                    yield from batch(rows)
                    rows, held = [], 0
                base = {"record": str(q["record"]), "geometry_id": q["geometry_id"], "band": q["band"]}
                try:
                    url = q["href"]
                    if url not in heads:
                        heads = {url: Header.of(json.loads(q["head"])) if q["head"] else parse(lambda at, n, u=url: source.get_range(u, at, n))}
                    h = heads[url]
                    p = wkb.parse(q["geometry"])
                    if p is None:
                        raise ValueError("unsupported geometry")
                    if h.epsg and q["geometry_epsg"] != h.epsg:
                        p = [[np.column_stack(crs.transform(r[:, 0], r[:, 1], q["geometry_epsg"], h.epsg)) for r in rings] for rings in p]
                    got = read_area(source, url, h, q["band_index"], p, **kw)
                    if got is None:
                        continue
                    if to:
                        got = regridded(got, h.epsg or 4326, *to, method)
                    d = transform_fn(got["data"]) if transform_fn else got["data"]
                    held += d.nbytes
                    rows.append(base | {"height": d.shape[0], "width": d.shape[1], "dtype": str(d.dtype), "data": d.tobytes(), "valid": np.packbits(got["valid"]).tobytes(), "transform": list(got["transform"]), "fill": got["fill"], "error": None})
                except Exception as e:
                    rows.append(base | {"error": f"{type(e).__name__}: {e}"[:200]})
            yield from batch(rows)

    return src.mapInArrow(run, FRAME)


def to_numpy(frame: DataFrame, bands: Sequence[str]) -> np.ndarray:
    """[N, H, W] of one band, [N, C, H, W] of several, by record and geometry; raises if all failed, or if shapes or counts differ."""
    import warnings

    rows = frame.orderBy("record", "geometry_id").collect()
    bad = [r for r in rows if r.error]
    good = [r for r in rows if not r.error]
    if bad and not good:
        raise RuntimeError(f"no read succeeded, e.g. {bad[0].error}")
    if bad:
        warnings.warn(f"{len(bad)} of {len(rows)} reads failed, e.g. {bad[0].error}", stacklevel=2)
    by: dict[tuple, dict] = {}
    for r in good:
        by.setdefault((r.record, r.geometry_id), {})[r.band] = np.frombuffer(r.data, r.dtype).reshape(r.height, r.width)
    if any(set(v) != set(bands) for v in by.values()):
        raise ValueError("samples have different bands")
    stacks = [np.stack([v[b] for b in bands]) if len(bands) > 1 else v[bands[0]] for v in by.values()]
    if len({s.shape for s in stacks}) > 1:
        raise ValueError("samples have different shapes; read a table instead")
    return np.stack(stacks)


# Image types that have no counterpart in common tensor libraries, and what they widen to.
WIDER = {"uint16": "int32", "uint32": "int64", "uint64": "int64"}


def tensor_ready(a: np.ndarray) -> np.ndarray:
    return a.astype(WIDER[str(a.dtype)]) if str(a.dtype) in WIDER else a
