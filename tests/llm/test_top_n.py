import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from scenegrain.llm import top_n as T

SCHEMA = "fid long, id string, bbox struct<xmin: double, ymin: double, xmax: double, ymax: double>, `eo:cloud_cover` double, ingested_at timestamp_ntz, place string, cloud double"
T0 = datetime(2025, 1, 1)


def records(spark, rows):
    return spark.createDataFrame([(f, i, b, c, T0 + timedelta(hours=h) if h is not None else None, "clash", 1.0) for f, i, b, c, h in rows], SCHEMA)


def box(k=0.0):
    k = float(k)
    return (k, 0.0, k + 1, 1.0)


def test_least_cloudy_dirty(spark):
    rows = [
        (1, "b", box(), 5.0, 0), (2, "a", box(1e-8), 5.0, 0), (3, "c", box(), 5.0, 0), (4, "d", box(), 4.0, 0), (4, "d", box(), 99.0, 5),  # redelivered worse
        (5, "e", box(), None, 0), (6, "f", box(), float("nan"), 0), (7, "g", box(), -1.0, 0), (8, "h", box(), 100.5, 0), (9, "i", None, 0.0, 0), (None, "n", box(), 0.0, 0),
        (10, "j", box(5), 100.0, 0), (10, "j", box(5), 100.0, 0), (11, None, box(7), 0.0, 0), (12, "x" * 100_000, box(7), 0.0, None),
    ]
    got = T.least_cloudy(records(spark, rows)).select("fid").collect()
    assert sorted(r.fid for r in got) == [1, 2, 3, 10, 11, 12]


def test_empty(spark):
    assert T.least_cloudy(records(spark, [])).count() == 0
    assert T.least_cloudy(records(spark, [(1, "a", None, 1.0, 0)])).count() == 0


@pytest.mark.parametrize("n", [1, 3, 50])
def test_skipping_equals_brute_force_with_a_hot_group_and_ties(spark, n, monkeypatch):
    monkeypatch.setattr(T, "ROW_GROUP_ROWS", 100)
    rng = random.Random(n)
    rows = [(rng.choice(["hot"] * 6 + [f"g{k}" for k in range(40)]), float(rng.randrange(0, 400)), i, "p" * 40) for i in range(30_000)]
    df = spark.createDataFrame(rows, "g string, s double, i long, pad string")
    path = T.cluster_files(df, "g", "s", ["i"], partitions=5)
    read = spark.read.schema(df.schema).parquet(path)
    stats = T.row_group_stats(read, "g", "s").cache()
    want = {}
    for g, s, i, _ in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        want.setdefault(g, []).append(i)
    got = {(r.g, r.i) for r in T.top_n(read, "g", "s", ["i"], n).collect()}
    assert got == {(g, i) for g, ids in want.items() for i in ids[:n]}
    assert stats.count() > 20 and T.wanted_row_groups(stats, n).count() < stats.count() / 2


def test_row_groups_are_skipped_among_the_places_of_a_collection(spark):
    rng = random.Random(9)
    rows = [(i, f"r{i:06d}", box(0 if i % 3 else rng.randrange(4000)), round(rng.uniform(0, 100), 1), 0) for i in range(24_000)]
    df = records(spark, rows)
    read, stats, wanted = T.clustered_places(df, 3)
    stats, wanted = stats.cache(), wanted.cache()
    assert stats.agg(F.sum("rows")).first()[0] == 24_000 and stats.count() - wanted.count() >= 2
    assert stats.filter("g_min < g_max").count() == wanted.filter("g_min < g_max").count() > 3  # of several places: all have winners
    by = {}
    for f, i, b, c, _ in rows:
        by.setdefault(b, []).append((c, i, f))
    assert {r.fid for r in T.least_cloudy(df, 3).collect()} == {f for v in by.values() for _, _, f in sorted(v)[:3]}


def test_window_form(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 3)], "g string, s int")
    assert T.top_n_window(df, ["g"], ["s"], 2).count() == 3
