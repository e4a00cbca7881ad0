"""Arrays of an area from several records: merged on one grid or stacked in time, with coordinates and system; masks as polygons."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MERGES = ("combine_first", "merge", "merge_override")
GRID = "geometry_id long, band string, times array<timestamp_ntz>, height int, width int, data array<double>, transform array<double>, records int, error string"
_KINDS = pa.schema([("geometry_id", pa.int64()), ("band", pa.string()), ("times", pa.list_(pa.timestamp("us"))), ("height", pa.int32()), ("width", pa.int32()), ("data", pa.list_(pa.float64())), ("transform", pa.list_(pa.float64())), ("records", pa.int32()), ("error", pa.string())])


def union_grid(transforms: Sequence[Sequence[float]], shapes: Sequence[tuple[int, int]], slack: float = 1e-6) -> tuple[tuple[float, float, float, float], int, int, list[tuple[int, int]]]:
    """Transform, height and width of the least grid that holds windows of one resolution, and the place of each; windows off the grid raise."""
    sx, _, sy, _ = transforms[0]
    if any(abs(t[0] - sx) > slack * abs(sx) or abs(t[2] - sy) > slack * abs(sy) for t in transforms):
        raise ValueError("windows of different resolution; bring them onto one grid first")
    tx = min(t[1] for t in transforms) if sx > 0 else max(t[1] for t in transforms)
    ty = min(t[3] for t in transforms) if sy > 0 else max(t[3] for t in transforms)
    at = []
    for t in transforms:
        c, r = (t[1] - tx) / sx, (t[3] - ty) / sy
        if abs(c - round(c)) > 1e-3 or abs(r - round(r)) > 1e-3:
            raise ValueError("windows are not on one grid; bring them onto one first")
        at.append((round(r), round(c)))
    return (sx, tx, sy, ty), max(r + h for (r, _), (h, _) in zip(at, shapes)), max(c + w for (_, c), (_, w) in zip(at, shapes)), at


def merged(windows: Sequence[np.ndarray], at: Sequence[tuple[int, int]], height: int, width: int, how: str = "combine_first") -> np.ndarray:
    """Windows (NaN: not valid) on one grid. ``combine_first``: the first valid value; ``merge_override``: the last; ``merge``: the one, values that differ raise."""
    if how not in MERGES:
        raise ValueError(f"how is one of {MERGES}")
    out = np.full((height, width), np.nan)
    for a, (r, c) in zip(windows, at):
        part = out[r : r + a.shape[0], c : c + a.shape[1]]
        have, new = ~np.isnan(part), ~np.isnan(a)
        if how == "merge" and (part[have & new] != a[have & new]).any():
            raise ValueError("records disagree")
        take = new if how == "merge_override" else new & ~have
        part[take] = a[take]
    return out


def _window(q: dict) -> np.ndarray:
    a = np.frombuffer(q["data"], q["dtype"]).reshape(q["height"], q["width"]).astype("f8")
    ok = np.unpackbits(np.frombuffer(q["valid"], "u1"), count=a.size).astype(bool).reshape(a.shape)
    return np.where(ok, a, np.nan)


def on_one_grid(frame: DataFrame, times: DataFrame | None = None, how: str = "combine_first", stack: bool = False) -> DataFrame:
    """Rows (``GRID``) per area and band of an area frame: its records merged in their order, or with ``stack`` one layer a moment, in order of time.

    ``times`` (record, datetime) gives the order; without it records go by name, and there is nothing to stack. What no record covers is NaN.
    Windows of one area and band meet in one task: an area is what a caller would hold as one array. Windows that
    don't fit, or that ``merge`` finds to disagree, give a row with an ``error``.
    """
    if stack and times is None:
        raise ValueError("a stack needs the records' times")
    f = frame.filter("error IS NULL").select("record", "geometry_id", "band", "height", "width", "dtype", "data", "valid", "transform")
    from pyspark.sql import functions as F

    f = f.join(times.select(F.col("record").cast("string").alias("record"), F.col("datetime").cast("timestamp_ntz").alias("datetime")), "record", "left") if times is not None else f.withColumn("datetime", F.lit(None).cast("timestamp_ntz"))

    def build(t: pa.Table) -> pa.Table:
        rows = t.sort_by([("datetime", "ascending"), ("record", "ascending")]).to_pylist()
        base = {"geometry_id": rows[0]["geometry_id"], "band": rows[0]["band"], "records": len(rows)}
        try:
            (sx, tx, sy, ty), h, w, at = union_grid([r["transform"] for r in rows], [(r["height"], r["width"]) for r in rows])
            windows = [_window(r) for r in rows]
            if stack:
                moments = sorted({r["datetime"] for r in rows}, key=lambda x: (x is None, x))
                layers = [merged(*zip(*[(a, p) for r, a, p in zip(rows, windows, at) if r["datetime"] == m]), h, w, how) for m in moments]
            else:
                moments, layers = [], [merged(windows, at, h, w, how)]
            base |= {"times": moments, "height": h, "width": w, "data": np.concatenate([x.ravel() for x in layers]), "transform": [sx, tx, sy, ty]}
        except ValueError as e:
            base["error"] = str(e)
        return pa.Table.from_pylist([base], schema=_KINDS)

    return f.groupBy("geometry_id", "band").applyInArrow(build, GRID)


def spatial_ref(epsg: int | None, transform: Sequence[float]) -> dict:
    """The attributes of a grid-mapping variable by the CF conventions: the system, and the transform in GDAL's order."""
    sx, tx, sy, ty = transform
    code = f"EPSG:{epsg}" if epsg else ""
    return {"grid_mapping_name": "latitude_longitude" if epsg == 4326 else "", "spatial_ref": code, "crs_wkt": code, "GeoTransform": f"{tx} {sx} 0.0 {ty} 0.0 {sy}"}


def labelled(grids: DataFrame, bands: Sequence[str], epsg: int | None = None) -> dict[int, dict]:
    """{geometry_id: {data: [band, (time,) y, x], coords: {band, time, y, x}, attrs}} of results that fit the driver; y and x are pixel centres, north first.

    Areas with an error are left out with a warning; all with one raise. Bands of an area on different grids raise.
    """
    import warnings

    rows = grids.collect()
    bad = [r.error for r in rows if r.error]
    if bad and len(bad) == len(rows):
        raise RuntimeError(f"no area could be put together, e.g. {bad[0]}")
    if bad:
        warnings.warn(f"{len(bad)} of {len(rows)} areas failed, e.g. {bad[0]}", stacklevel=2)
    out: dict[int, dict] = {}
    for g in sorted({r.geometry_id for r in rows if not r.error}):
        own = {r.band: r for r in rows if r.geometry_id == g and not r.error}
        if set(own) != set(bands) or len({(tuple(r.transform), r.height, r.width, tuple(r.times)) for r in own.values()}) > 1:
            raise ValueError(f"bands of area {g} are missing or on different grids")
        first = own[bands[0]]
        sx, tx, sy, ty = first.transform
        y, x = ty + (np.arange(first.height) + 0.5) * sy, tx + (np.arange(first.width) + 0.5) * sx
        shape = (len(first.times), first.height, first.width) if first.times else (first.height, first.width)
        data = np.stack([np.reshape(own[b].data, shape) for b in bands])
        if sy > 0:
            data, y = data[..., ::-1, :], y[::-1]
        coords = {"band": list(bands), **({"time": list(first.times)} if first.times else {}), "y": y, "x": x}
        out[g] = {"data": data, "coords": coords, "attrs": spatial_ref(epsg, first.transform)}
    return out


def polygons_of(mask: np.ndarray, transform: Sequence[float] = (1.0, 0.0, 1.0, 0.0)) -> list[list[list[tuple[float, float]]]]:
    """The connected areas of a mask (edges touch) as polygons along the pixels' edges: each its outer ring, then its holes; rings are closed."""
    from scenegrain.operators.raster_read import shapes

    sx, tx, sy, ty = transform
    label = shapes(mask, labels=True)
    out = []
    for k in range(1, int(label.max(initial=0)) + 1):
        own = np.pad(label == k, 1)
        r, c = (v - 1 for v in np.nonzero(own))
        steps: dict[tuple[int, int], list[tuple[int, int]]] = {}
        # each open side of a pixel, with the area to its right
        for dr, dc, a, b in ((-1, 0, (0, 0), (0, 1)), (0, 1, (0, 1), (1, 1)), (1, 0, (1, 1), (1, 0)), (0, -1, (1, 0), (0, 0))):
            side = ~own[r + 1 + dr, c + 1 + dc]
            for i, j in zip(r[side].tolist(), c[side].tolist()):
                steps.setdefault((i + a[0], j + a[1]), []).append((i + b[0], j + b[1]))
        rings = []
        while steps:
            start = min(steps)
            at, before, ring = start, None, [start]
            while True:
                ways = steps[at]
                # where two areas meet at a corner, keep to the right
                turn = lambda n, at=at, before=before: (before[1] * (n[0] - at[0]) - before[0] * (n[1] - at[1])) if before else 0
                n = max(ways, key=turn)
                ways.remove(n)
                if not ways:
                    del steps[at]
                step = (n[0] - at[0], n[1] - at[1])
                if before == step:
                    ring[-1] = n
                else:
                    ring.append(n)
                at, before = n, step
                if at == start:
                    break
            if len(ring) > 2 and (ring[1][0] - ring[0][0] == 0) == (ring[-1][0] - ring[-2][0] == 0):  # the start lies on a straight side
                ring = [*ring[1:-1], ring[1]]
            rings.append([(tx + q * sx, ty + p * sy) for p, q in ring])
        rings.sort(key=lambda g: -abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(g[:-1], g[1:]))))
        out.append(rings)
    return out
