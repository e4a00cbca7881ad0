"""Planar polygon kernels on edge arrays: canonical form, trapezoidal slabs, shared area, covered cells."""

from __future__ import annotations

import hashlib
import struct

import numpy as np

from scenegrain.functions import wkb


def _canonical_ring(ring: np.ndarray, outer: bool) -> bytes:
    q = ring[:-1] if len(ring) > 1 and (ring[0] == ring[-1]).all() else ring
    q = q[(q != np.roll(q, 1, axis=0)).any(axis=1)]
    if len(q) > 3:
        a, b = q - np.roll(q, 1, axis=0), np.roll(q, -1, axis=0) - q
        bent = np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]) > 1e-11
        q = q[bent] if bent.sum() >= 3 else q
    x, y = q[:, 0], q[:, 1]
    turned = (x * np.roll(y, -1) - np.roll(x, -1) * y).sum() > 0
    if turned != outer:
        q = q[::-1]
    q = np.roll(q, -np.lexsort((q[:, 1], q[:, 0]))[0], axis=0) if len(q) else q
    return (np.round(q, 9) + 0.0).tobytes()


def key(polygons: list[list[np.ndarray]]) -> int:
    """Equal for footprints written in different but equal ways: byte order, start, direction, order of parts, points on straight edges."""
    parts = sorted(_canonical_ring(r[0], True) + b"|" + b"|".join(sorted(_canonical_ring(h, False) for h in r[1:])) for r in polygons)
    return struct.unpack("<q", hashlib.blake2b(b"||".join(parts), digest_size=8).digest())[0]


def _x_at(e: np.ndarray, y) -> np.ndarray:
    return e[:, 0] + (y - e[:, 1]) * (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])


def _crossings(e: np.ndarray, y0: float, y1: float) -> np.ndarray:
    """Heights at which edges cross inside a slab; regions whose rings cross each other have such."""
    s = e[(e[:, 1] <= y0) & (e[:, 3] >= y1)]
    a, b = _x_at(s, y0), _x_at(s, y1)
    at = np.lexsort((b, a))
    a, b = a[at], b[at]
    if (np.diff(b) >= -1e-12).all():
        return np.empty(0)
    d0, d1 = a[:, None] - a[None, :], b[:, None] - b[None, :]
    i, j = np.nonzero((d0 < 0) & (d1 > 1e-12))
    y = y0 + (y1 - y0) * d0[i, j] / (d0[i, j] - d1[i, j])
    return y[(y > y0) & (y < y1)]


def slabs(polygons: list[list[np.ndarray]], cell: float):
    """Trapezoidal decomposition, cut along a grid: yields (cx, cy, packed slabs) for each cell the region may contain points of.

    All vertex heights, crossings of edges, and the grid's lines part the region into slabs in which its edges don't cross
    and are stored in order of x. Of each slab a cell gets the edges that reach the cell, and the number
    of those wholly to its left; so a region of any size is spread over its cells.
    """
    e = wkb.edges(polygons)
    e = e[e[:, 1] != e[:, 3]]
    if not len(e):
        return
    down = e[:, 1] > e[:, 3]
    e[down] = e[down][:, [2, 3, 0, 1]]
    x0, x1 = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2])
    for cy in range(int(np.floor(e[:, 1].min() / cell)), int(np.floor(e[:, 3].max() / cell)) + 1):
        lo, hi = cy * cell, (cy + 1) * cell
        band = (e[:, 1] < hi) & (e[:, 3] > lo)
        if not band.any():
            continue
        be, b0, b1 = e[band], x0[band], x1[band]
        ys = np.unique(np.clip(np.concatenate([be[:, 1], be[:, 3], [lo, hi]]), lo, hi))
        ys = np.unique(np.concatenate([ys, *(_crossings(be, y0, y1) for y0, y1 in zip(ys[:-1], ys[1:]))]))
        rows = []
        for y0, y1 in zip(ys[:-1], ys[1:]):
            own = (be[:, 1] <= y0) & (be[:, 3] >= y1)
            s = be[own]
            a, b = _x_at(s, y0), _x_at(s, y1)
            at = np.argsort(a + b, kind="stable")
            rows.append((s[at], np.minimum(a, b)[at], np.maximum(a, b)[at]))
        for cx in range(int(np.floor(b0.min() / cell)), int(np.floor(b1.max() / cell)) + 1):
            left, right = cx * cell, (cx + 1) * cell
            skip = [int((mx < left).sum()) for _, _, mx in rows]
            kept = [s[k : len(s) - int((mn[k:] > right).sum())] for (s, mn, mx), k in zip(rows, skip)]
            if not any(len(k) for k in kept) and not any(n % 2 for n in skip):
                continue
            ends = np.cumsum([len(k) for k in kept])
            yield cx, cy, struct.pack("<II", len(kept), int(ends[-1])) + ys.tobytes() + np.asarray(skip, "<i4").tobytes() + ends.astype("<i4").tobytes() + np.concatenate(kept).astype("<f8").tobytes()


def locate(packed: bytes, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which points of a cell lie in the region: binary search for the slab, then for the place among its ordered edges."""
    n, m = struct.unpack_from("<II", packed)
    at = 8
    ys = np.frombuffer(packed, "<f8", n + 1, at)
    at += 8 * (n + 1)
    skip = np.frombuffer(packed, "<i4", n, at)
    at += 4 * n
    ends = np.frombuffer(packed, "<i4", n, at)
    at += 4 * n
    e = np.frombuffer(packed, "<f8", 4 * m, at).reshape(m, 4)
    slab = np.searchsorted(ys, y, side="right") - 1
    ok = (slab >= 0) & (slab < n)
    s = np.where(ok, slab, 0)
    first = np.where(s > 0, ends[s - 1], 0)
    lo, hi = first.copy(), ends[s].copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        g = e[np.minimum(mid, max(m - 1, 0))] if m else np.zeros((len(x), 4))
        left = open_ & (g[:, 0] + (y - g[:, 1]) * (g[:, 2] - g[:, 0]) / np.where(g[:, 3] == g[:, 1], 1, g[:, 3] - g[:, 1]) <= x)
        lo = np.where(left, mid + 1, lo)
        hi = np.where(open_ & ~left, mid, hi)
    return ok & ((lo - first + skip[s]) % 2 == 1)


def shared_thickness(a: list[list[np.ndarray]], b: list[list[np.ndarray]]) -> float:
    """Area over diagonal of the thickest connected piece that two regions share; 0 if they share none.

    Slabs between all vertex heights and crossings of edges: in each, both regions' edges are in order
    and don't cross, so each shared interval is a trapezoid. Trapezoids that meet along a slab's border belong to one piece.
    """
    ea, eb = (x[x[:, 1] != x[:, 3]] for x in (wkb.edges(a), wkb.edges(b)))
    if not len(ea) or not len(eb):
        return 0.0
    ea, eb = (np.where((x[:, 1] > x[:, 3])[:, None], x[:, [2, 3, 0, 1]], x) for x in (ea, eb))
    lo, hi = max(ea[:, 1].min(), eb[:, 1].min()), min(ea[:, 3].max(), eb[:, 3].max())
    if lo >= hi:
        return 0.0
    ma, mb = ((x[:, 2] - x[:, 0]) / (x[:, 3] - x[:, 1]) for x in (ea, eb))
    ka, kb = ea[:, 0] - ma * ea[:, 1], eb[:, 0] - mb * eb[:, 1]
    dm = ma[:, None] - mb[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        yc = (kb[None, :] - ka[:, None]) / dm
    yc = yc[np.isfinite(yc)]
    ys = np.unique(np.concatenate([ea[:, 1], ea[:, 3], eb[:, 1], eb[:, 3], yc]))
    ys = ys[(ys >= lo) & (ys <= hi)]
    pieces: list[list[float]] = []  # area and box
    into: list[int] = []

    def find(k: int) -> int:
        while into[k] != k:
            into[k] = into[into[k]]
            k = into[k]
        return k

    below: list[tuple[float, float, int]] = []
    for y0, y1 in zip(ys[:-1], ys[1:]):
        mid = (y0 + y1) / 2
        sa, sb = (x[(x[:, 1] <= mid) & (x[:, 3] >= mid)] for x in (ea, eb))
        sa, sb = (x[np.argsort(_x_at(x, mid), kind="stable")] for x in (sa, sb))
        (a0, am, a1), (b0, bm, b1) = ([_x_at(x, y) for y in (y0, mid, y1)] for x in (sa, sb))
        here = []
        for i in range(0, len(am) - 1, 2):
            for j in range(0, len(bm) - 1, 2):
                l, r = max(am[i], bm[j]), min(am[i + 1], bm[j + 1])
                if r > l:
                    foot = max(a0[i], b0[j]), min(a0[i + 1], b0[j + 1])
                    head = max(a1[i], b1[j]), min(a1[i + 1], b1[j + 1])
                    k = len(pieces)
                    pieces.append([(r - l) * (y1 - y0), l, y0, r, y1])
                    into.append(k)
                    for u, v, o in below:
                        # a common stretch of the border joins, a point doesn't
                        if min(v, foot[1]) > max(u, foot[0]) and find(o) != find(k):
                            p, q = pieces[find(o)], pieces[find(k)]
                            q[:] = [p[0] + q[0], min(p[1], q[1]), min(p[2], q[2]), max(p[3], q[3]), max(p[4], q[4])]
                            into[find(o)] = find(k)
                    here.append((*head, k))
        below = here
    return max((pieces[k][0] / float(np.hypot(pieces[k][3] - pieces[k][1], pieces[k][4] - pieces[k][2])) for k in range(len(pieces)) if into[k] == k), default=0.0)


def level_of(side: float) -> int:
    """The power of two that is at least ``side``."""
    return int(np.clip(np.ceil(np.log2(max(side, 2.0**-40))), -40, 10))


def covered_cells(polygons: list[list[np.ndarray]], level: int, at_once: int = 1 << 22) -> list[tuple[int, int]]:
    """Grid cells of side 2^``level`` that lie wholly inside the region: no edge enters them and their centre is inside."""
    e = wkb.edges(polygons)
    cell = 2.0**level
    out: set[tuple[int, int]] = set()
    for rings in polygons:
        x0, y0, x1, y1 = wkb.bounds([rings])
        c0, c1, r0, r1 = (int(np.floor(v / cell)) for v in (x0, x1, y0, y1))
        cols, rows = np.arange(c0, c1 + 1), np.arange(r0, r1 + 1)
        lo, hi = rows * cell, (rows + 1) * cell
        mid, centre = (rows + 0.5) * cell, (cols + 0.5) * cell
        free, odd = np.ones((len(rows), len(cols)), bool), np.zeros((len(rows), len(cols)), bool)
        step = max(1, at_once // free.size)
        for k in range(0, len(e), step):
            ax, ay, bx, by = (v[:, None] for v in e[k : k + step].T)
            flat = ay == by
            rise = np.where(flat, 1.0, by - ay)
            bottom, top = np.minimum(ay, by), np.maximum(ay, by)
            # the stretch of each edge within each row of cells
            t0, t1 = (np.where(flat, w, (np.clip(v, bottom, top) - ay) / rise) for v, w in ((lo[None, :], 0.0), (hi[None, :], 1.0)))
            xa, xb = ax + t0 * (bx - ax), ax + t1 * (bx - ax)
            meets = (bottom <= hi[None, :]) & (top >= lo[None, :])
            l, g = np.minimum(xa, xb), np.maximum(xa, xb)
            free &= ~(meets[:, :, None] & (cols * cell <= g[:, :, None]) & ((cols + 1) * cell >= l[:, :, None])).any(axis=0)
            cross = (ay > mid[None, :]) != (by > mid[None, :])
            at = ax + (mid[None, :] - ay) / rise * (bx - ax)
            odd ^= (cross[:, :, None] & (at[:, :, None] < centre)).sum(axis=0) % 2 == 1
        out.update((int(cols[j]), int(rows[i])) for i, j in zip(*np.nonzero(free & odd)))
    return sorted(out)


def _side(e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """[edge, point]: to which side of an edge's line points lie; 0 on it."""
    ax, ay, bx, by = (v[:, None] for v in e.T)
    return np.sign((bx - ax) * (y[None, :] - ay) - (by - ay) * (x[None, :] - ax))


def _meet(ea: np.ndarray, eb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[edge, edge]: whether two edges touch at all, and whether they cross in their insides."""
    a0, a1 = _side(ea, eb[:, 0], eb[:, 1]), _side(ea, eb[:, 2], eb[:, 3])
    b0, b1 = _side(eb, ea[:, 0], ea[:, 1]).T, _side(eb, ea[:, 2], ea[:, 3]).T
    lo = lambda e, i: np.minimum(e[:, i], e[:, i + 2])
    hi = lambda e, i: np.maximum(e[:, i], e[:, i + 2])
    boxes = np.ones((len(ea), len(eb)), bool)
    for i in (0, 1):
        boxes &= (lo(ea, i)[:, None] <= hi(eb, i)[None, :]) & (lo(eb, i)[None, :] <= hi(ea, i)[:, None])
    return boxes & (a0 * a1 <= 0) & (b0 * b1 <= 0), (a0 * a1 < 0) & (b0 * b1 < 0)


def within(e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether points lie in the region of the edges (even-odd)."""
    ax, ay, bx, by = (v[:, None] for v in e.T)
    cross = (ay > y[None, :]) != (by > y[None, :])
    at = ax + (y[None, :] - ay) * (bx - ax) / np.where(by == ay, 1.0, by - ay)
    return (cross & (at > x[None, :])).sum(axis=0) % 2 == 1


def intersects(a: list[list[np.ndarray]], b: list[list[np.ndarray]], at_once: int = 1 << 21) -> bool:
    """Whether two regions share a point, borders included."""
    ea, eb = wkb.edges(a), wkb.edges(b)
    step = max(1, at_once // max(len(eb), 1))
    if any(_meet(ea[k : k + step], eb)[0].any() for k in range(0, len(ea), step)):
        return True
    # without a common point of their borders, a part of one lies in the other or they are apart
    return bool(within(ea, *eb[:, :2].T).any() or within(eb, *ea[:, :2].T).any())


def covers(a: list[list[np.ndarray]], b: list[list[np.ndarray]]) -> bool:
    """Whether all of ``b`` lies in ``a``, borders included: no edges cross, and no piece of an edge of ``b``, nor a hole of ``a`` within ``b``, is outside."""
    ea, eb = wkb.edges(a), wkb.edges(b)
    touch, cross = _meet(ea, eb)
    if cross.any():
        return False
    # each edge of b is cut where a's edges touch it; the middle of every piece must be in a, or on its border
    xs, ys = [], []
    for j, (x0, y0, x1, y1) in enumerate(eb):
        d2 = (x1 - x0) ** 2 + (y1 - y0) ** 2
        ends = ea[touch[:, j]][:, [0, 1, 2, 3]].reshape(-1, 2)
        t = np.clip(((ends[:, 0] - x0) * (x1 - x0) + (ends[:, 1] - y0) * (y1 - y0)) / (d2 or 1.0), 0, 1)
        t = np.unique(np.concatenate([[0.0, 1.0], t]))
        m = (t[1:] + t[:-1]) / 2
        xs.append(x0 + m * (x1 - x0)), ys.append(y0 + m * (y1 - y0))
    x, y = np.concatenate(xs), np.concatenate(ys)
    ax, ay, bx, by = (v[:, None] for v in ea.T)
    long = np.hypot(bx - ax, by - ay)
    off = np.abs((bx - ax) * (y[None, :] - ay) - (by - ay) * (x[None, :] - ax)) / np.where(long == 0, 1.0, long)
    along = ((x[None, :] - ax) * (bx - ax) + (y[None, :] - ay) * (by - ay)) / np.where(long == 0, 1.0, long**2)
    on = ((off <= 1e-12) & (along >= 0) & (along <= 1)).any(axis=0)
    if not (on | within(ea, x, y)).all():
        return False
    holes = [h for rings in a for h in rings[1:]]
    return not any(within(eb, *(np.mean(h[:-1], axis=0)[:, None])).any() and within(eb, h[:-1, 0], h[:-1, 1]).any() for h in holes)
