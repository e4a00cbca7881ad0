import random

from scenegrain.functions import wkb
from scenegrain.llm import grouped_split as G


def square(x, y, s=1.0):
    return wkb.polygon([(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)])


SCHEMA = "fid long, geometry binary, split string, label long, region long, group string"


def records(spark, rows):
    return spark.createDataFrame([(*r, 5, "clash") for r in rows], SCHEMA)


def test_split_spellings(spark):
    df = spark.createDataFrame([(s,) for s in ("TRAIN ", "Training", " val", "valid ", "Validation", "testing", "TEST", "other", "", None)], "s string")
    got = [r[0] for r in df.select(G.split_meaning(df.s)).collect()]
    assert got == ["train", "train", "val", "val", "val", "test", "test", None, None, None]


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(330)) for _ in range(420)] + [(1000 + k, 5000 + k) for k in range(60)] + [(1001 + k, 5000 + k) for k in range(60)] + [(k, 9999) for k in range(100, 180)]
    par = {}
    def find(x):
        while par.setdefault(x, x) != x:
            x = par[x]
        return x
    for r, e in edges:
        par[find(("r", r))] = find(("e", e))
    groups = {}
    for r, _ in edges:
        groups.setdefault(find(("r", r)), set()).add(r)
    want = {r: min(g) for g in groups.values() for r in g}
    df = spark.createDataFrame(edges + edges[:50] + [(None, 1), (1, None)], "record long, entity long")
    assert {r.record: r.label for r in G.components(df).collect()} == want
    assert G.components(df.limit(0)).count() == 0


def test_torn_groups(spark):
    rows = [
        (1, square(0, 0), "train", 0), (2, square(0.5, 0.5), "val ", 0), (3, square(1.2, 1.2), None, 0),  # a chain 1-2-3
        (4, square(10, 0), "train", 1), (5, square(11, 0), "test", 1), (6, square(10, 1 - 1e-8), "test", 1),  # an edge; a thin strip
        (7, square(20, 0), "train", 1), (7, square(20, 0), "train", 1), (8, square(20, 0)[:30], "val", 1), (9, None, "test", 1), (10, b"", "val", 1),
        (11, wkb.multipolygon([[(30, 0), (31, 0), (31, 1), (30, 1), (30, 0)]], [[(40, 0), (41, 0), (41, 1), (40, 1), (40, 0)]]), "train", 0), (12, square(40.2, 0.2, 0.1), "Test", 0),
        (13, square(50, 0, 0.001), "val", 0), (14, square(50.0005, 0, 0.001), "train", 0),  # smaller than any cell
        (None, square(0, 0), "test", 0),
    ]
    got = {r.id for r in G.torn_groups(records(spark, rows)).collect()}
    assert got == {1, 2, 3, 11, 12, 13, 14}
    assert G.torn_groups(records(spark, [])).count() == 0


def test_one_crowded_cell_and_a_footprint_of_the_whole_earth(spark, monkeypatch):
    rng, tested = random.Random(3), []
    crowd = [(i, square(rng.uniform(5, 5.2), rng.uniform(45, 45.2), rng.uniform(0.02, 0.06)), "train", 0) for i in range(3000)]
    lone = [(10_000 + i, square(100 + 2 * i, -20 + i, 0.5), "val", 0) for i in range(30)]
    earth = (99_999, wkb.polygon([(-180, -90), (180, -90), (180, 90), (-180, 90), (-180, -90)]), "train", 0)
    regs = lambda rows: spark.createDataFrame([(r[0], r[1]) for r in rows], "region long, geometry binary")
    got = {r.region: r.group for r in G.shared_ground(regs(crowd + lone)).collect()}
    assert len(got) == 3030 and len({got[i] for i in range(3000)}) == 1 and len(set(got.values())) == 31
    got = {r.region: r.group for r in G.shared_ground(regs(crowd + lone + [earth])).collect()}
    assert len(got) == 3031 and len(set(got.values())) == 1
    assert len(G._cover(1, wkb.parse(earth[1]))) < 200 and len(G._boxes(1, wkb.parse(earth[1]))) <= 4


def test_the_assignment_lowers_the_deviation_of_labels(spark):
    rng = random.Random(11)
    # groups of mixed labels, many small ones, a few large and one of a third of all rows
    rows = [(g, rng.choice("aaab") if rng.random() < 0.7 else "cd"[g % 2]) for g in range(4000) for _ in range(rng.randrange(1, 5))]
    rows += [(9000 + k, rng.choice("abcd")) for k in range(20) for _ in range(150)] + [(9999, "ab"[i % 2]) for i in range(6000)]
    m = spark.createDataFrame(rows, "group long, label string")
    targets = spark.createDataFrame([("train", 0.7), ("val", 0.15), ("test", 0.15)], "split string, share double")
    line = lambda **kw: {r.split: r for r in G.deviation(m, G.assign_splits(m, targets, **kw), targets).collect()}
    plain, moved, full = line(rounds=0, at_once=1), line(rounds=4, at_once=50), line()
    worst = lambda d: max(r.label_deviation for r in d.values())
    assert worst(moved) < worst(plain) and worst(full) < 0.01
    assert all(abs(r.rows - r.wanted) < 0.01 * len(rows) for r in full.values())
    assert sum(r.rows for r in full.values()) == len(rows)


def test_splits_keep_groups_whole_near_the_shares(spark):
    rng = random.Random(7)
    rows = [(i, square(2 * rng.randrange(600), 3 * (i % 7)), None, i % 3) for i in range(3000)] + [(i, None, None, 1) for i in range(3000, 3200)] + [(4000 + i, square(-100, -50), None, 2) for i in range(400)]
    targets = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1), (None, 0.5), ("none", 0.0)], "split string, share double")
    got = G.split_records(records(spark, rows), targets).collect()
    assert len(got) == 3600 and len({r.id for r in got}) == 3600
    by = {}
    for r in got:
        by.setdefault(r.group, set()).add(r.split)
    assert all(len(s) == 1 for s in by.values())
    for s, share in (("train", 0.8), ("val", 0.1), ("test", 0.1)):
        assert abs(sum(r.split == s for r in got) / 3600 - share) < 0.03
    assert G.split_records(records(spark, []), targets).count() == 0
