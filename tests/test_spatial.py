import math
import random

import numpy as np
import pytest

from scenegrain.functions import polygons, wkb
from scenegrain.operators import spatial as S

P = "point_index long, sensor_id string, plot_id string, point_x double, point_y double, point_crs int, geometry binary, sent_at timestamp_ntz, lon double, cx long"
R = "fid long, geometry binary, id string, region long"


def points(spark, rows):
    return spark.createDataFrame([(i, None, None, x, y, c, g, None, 1.0, 2) for i, x, y, c, g in rows], P)


def even_odd(polys, x, y):
    inside = False
    for x0, y0, x1, y1 in wkb.edges(polys):
        if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
            inside = not inside
    return inside


def test_slabs_agree_with_even_odd_on_random_stars_with_holes():
    rng = random.Random(3)
    for k in range(40):
        n = rng.randint(3, 30)
        cx, cy = rng.uniform(-1, 1), rng.uniform(-1, 1)
        ang = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
        ring = [(cx + rng.uniform(0.3, 1.2) * math.cos(a), cy + rng.uniform(0.3, 1.2) * math.sin(a)) for a in ang]
        hole = [(cx + 0.05 * math.cos(a), cy + 0.05 * math.sin(a)) for a in (0, 2, 4)]
        p = wkb.parse(wkb.polygon([*ring, ring[0]], [*hole, hole[0]]))
        cell = 0.25
        table = {(a, b): s for a, b, s in polygons.slabs(p, cell)}
        xs, ys = np.array([[rng.uniform(-2.5, 2.5), rng.uniform(-2.5, 2.5)] for _ in range(300)]).T
        for x, y in zip(xs, ys):
            s = table.get((math.floor(x / cell), math.floor(y / cell)))
            got = s is not None and bool(polygons.locate(s, np.array([x]), np.array([y]))[0])
            assert got == even_odd(p, x, y), (k, x, y)


def test_equal_footprints_have_one_key():
    ring = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    mid = [(1, 0), (1, 0.5), (1, 1), (0, 1), (0, 0), (1, 0)]
    a, b, c = (polygons.key(wkb.parse(x)) for x in (wkb.polygon(ring), wkb.polygon(mid[::-1]), wkb.multipolygon([ring])))
    assert a == b == c
    assert a != polygons.key(wkb.parse(wkb.polygon([(0, 0), (1, 0), (1, 1.001), (0, 1), (0, 0)])))


@pytest.mark.parametrize("raw", [None, b"", b"\x01", b"\x05abc", wkb.polygon(), wkb.point(1, 2), wkb.polygon([(0, 0), (1, 1), (0, 0)])[:20], wkb.polygon([(0, 0), (float("nan"), 1), (1, 1), (0, 0)])])
def test_unreadable_footprints(raw):
    assert wkb.parse(raw) is None


def test_neighbours_small_and_dirty(spark):
    m = 111_195.08  # metres a degree on this sphere
    pts = points(spark, [
        (1, 10.0, 50.0, 4326, None), (1, 10.0, 50.0, 4326, None), (2, 10.0, 50.0 + 200 / m, None, None), (3, 10.0, 50.0 + 460 / m, 4326, None),
        (4, math.radians(10.0) * S.MERCATOR_M, math.asinh(math.tan(math.radians(50.0))) * S.MERCATOR_M, 3857, None), (5, 179.9999, 0.5, 4326, None), (6, -179.9999, 0.5, 4326, None),
        (7, None, 50.0, 4326, None), (8, float("nan"), 50.0, 4326, None), (9, 200.0, 50.0, 4326, None), (10, 1.0, 1.0, 9999, None), (11, 0.0, 0.0, 4326, wkb.point(10.0, 50.0)),
        (12, 10.0, 50.0, 4326, b"junk"), (None, 10.0, 50.0, 4326, None), (13, 10.0, 90.0, 4326, None), (14, -170.0, 90.0, 4326, None),
    ])
    near = {(r.left_id, r.right_id) for r in S.near_pairs(S.placed_points(pts), 250.0).collect()}
    assert near == {(1, 2), (1, 4), (2, 4), (5, 6), (1, 11), (2, 11), (4, 11), (13, 14)}
    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    recs = spark.createDataFrame([
        (1, wkb.polygon(box(9, 49, 11, 51)), "a", 1), (2, wkb.polygon(box(9, 49, 11, 51)[::-1]), "b", 1), (2, wkb.polygon(box(9, 49, 11, 51)[::-1]), "b", 1),
        (3, wkb.polygon(box(9, 49, 11, 51), box(9.5, 49.5, 10.5, 50.5)), "c", 1), (4, None, "d", 1), (5, b"", "e", 1), (None, wkb.polygon(box(9, 49, 11, 51)), "f", 1),
        (6, wkb.multipolygon([box(179, 0, 180, 1)], [box(-180, 0, -179, 1)]), "g", 1),
    ], R)
    inside = {(r.point, r.id) for r in S.points_in_records(pts, recs).collect()}
    assert inside == {(p, r) for p in (1, 2, 3, 4, 11) for r in (1, 2)} | {(5, 6), (6, 6)}


def test_near_pairs_agree_with_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        lat = rng.choice([0.0, 45.0, 89.99, -89.995, 60.0]) + rng.uniform(-0.01, 0.01)
        rows.append((i, rng.choice([-180.0, 0.0, 179.99]) + rng.uniform(0, 0.01), max(-90.0, min(90.0, lat)), 4326, None))
    got = {(r.left_id, r.right_id) for r in S.near_pairs(S.placed_points(points(spark, rows)), 250.0).collect()}
    def metres(a, b):
        x = math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * S.EARTH_M * math.asin(min(1, math.sqrt(x)))
    assert got == {(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if metres(a, b) <= 250}


def test_empty_tables(spark):
    assert S.neighbours(points(spark, []), spark.createDataFrame([], R)).count() == 0
    assert S.points_in_records(points(spark, [(1, 1.0, 1.0, 4326, None)]), spark.createDataFrame([], R)).count() == 0


def test_hot_cell_is_salted(spark, monkeypatch):
    from scenegrain.operators import joins

    a = spark.range(1000).selectExpr("1 as k", "id")
    b = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, v string")
    got = joins.salted_join(a, b, ["k"], per_task=100)
    assert got.count() == 2000 and got.select("id").distinct().count() == 1000


def test_shared_thickness():
    sq = lambda x, y, s=1.0: wkb.parse(wkb.polygon([(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]))
    assert polygons.shared_thickness(sq(0, 0), sq(0.5, 0.5)) > 0.1
    assert polygons.shared_thickness(sq(0, 0), sq(1, 0)) == 0 and polygons.shared_thickness(sq(0, 0), sq(3, 0)) == 0
    assert 0 < polygons.shared_thickness(sq(0, 0), sq(1 - 1e-8, 0)) < 1e-6
    assert 0 < polygons.shared_thickness(sq(0, 0), sq(0, 1 - 1e-8)) < 1e-6
    assert polygons.shared_thickness(sq(0, 0, 4), sq(1, 1)) > 0.1


def test_shared_thickness_is_of_the_thickest_piece():
    sq = lambda x, y, s: [np.array([[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]], float)]
    apart = [sq(0, 0, 3e-4), sq(0.25, 0, 3e-4)]
    assert abs(polygons.shared_thickness(apart, apart) - 3e-4 / 2**0.5) < 1e-9
    far = [sq(0, 0, 3e-4), sq(0, 0.25, 3e-4)]
    assert abs(polygons.shared_thickness(far, far) - 3e-4 / 2**0.5) < 1e-9


def test_intersects_and_covers_against_dense_points():
    rng = random.Random(8)

    def star(cx, cy, r, hole=False):
        n = rng.randint(3, 9)
        ring = [(cx + r * rng.uniform(0.4, 1) * math.cos(a), cy + r * rng.uniform(0.4, 1) * math.sin(a)) for a in sorted(rng.uniform(0, 6.28) for _ in range(n))]
        inner = [[(cx + 0.1 * r * math.cos(a), cy + 0.1 * r * math.sin(a)) for a in (0, 2, 4, 0)]] if hole else []
        return wkb.parse(wkb.polygon([*ring, ring[0]], *inner))

    xs, ys = (v.ravel() for v in np.meshgrid(np.linspace(-2, 2, 161), np.linspace(-2, 2, 161)))
    for _ in range(150):
        a, b = star(0, 0, 1.5, rng.random() < 0.3), star(rng.uniform(-1.5, 1.5), rng.uniform(-1.5, 1.5), rng.uniform(0.1, 1))
        ia, ib = (polygons.within(wkb.edges(p), xs, ys) for p in (a, b))
        if (ia & ib).any():
            assert polygons.intersects(a, b) and polygons.intersects(b, a)
        if polygons.covers(a, b):
            assert not (ib & ~ia).any()
    box = lambda x0, y0, x1, y1, *h: wkb.parse(wkb.polygon([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)], *h))
    hole = [(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)]
    assert polygons.intersects(box(0, 0, 1, 1), box(1, 1, 2, 2)) and not polygons.intersects(box(0, 0, 1, 1), box(1.1, 0, 2, 1)) and polygons.intersects(box(0, 0, 9, 9), box(3, 3, 4, 4))
    assert polygons.covers(box(0, 0, 9, 9), box(0, 0, 9, 9)) and polygons.covers(box(0, 0, 9, 9), box(0, 3, 4, 4)) and not polygons.covers(box(3, 3, 4, 4), box(0, 0, 9, 9))
    assert not polygons.covers(box(0, 0, 9, 9, hole), box(3, 3, 7, 7)) and polygons.covers(box(0, 0, 9, 9, hole), box(1, 1, 4, 4)) and not polygons.intersects(box(0, 0, 9, 9, hole), box(4.5, 4.5, 5, 5))
