import random
import re
import statistics
from datetime import datetime

from scenegrain.operators import quality_profile as Q

SCHEMA = "load_id long, `eo:cloud_cover` double, datetime timestamp_ntz, crs string, ingested_at timestamp_ntz, load long, v string, n int"


def table(spark, rows):
    return spark.createDataFrame([(l, c, d, s, datetime(2025, 1, 1), 9, "clash", 1) for l, c, d, s in rows], SCHEMA)


def many(load, n, rng, **kw):
    return [(load, kw.get("cloud", lambda: round(rng.uniform(0, 60), 2))(), kw.get("time", lambda: datetime(2020, 1, 1, rng.randrange(24), rng.randrange(60)))(), kw.get("crs", lambda: f"EPSG:326{rng.randrange(10, 60)}")()) for _ in range(n)]


def test_issues(spark):
    rng = random.Random(1)
    rows = [r for l in range(8) for r in many(l, 100, rng)]
    rows += many(10, 100, rng, cloud=lambda: rng.choice([None, float("nan"), 5.0, 20.0, 30.0, 40.0, 45.0]))
    rows += many(11, 100, rng, cloud=lambda: rng.choice([101.0, 30.0, 20.0, 35.0, 50.0]))
    rows += many(12, 100, rng, crs=lambda: rng.choice(["EPSG:32632", "epsg:32632", "EPSG:32632 ", "EPSG:32632\n"]))
    rows += many(13, 100, rng, cloud=lambda: round(rng.uniform(70, 99), 2))
    rows += many(14, 100, rng, time=lambda: datetime(1970, 1, 1, rng.randrange(24)))
    rows += many(15, 100, rng, crs=lambda: "EPSG:32632")
    rows += many(None, 100, rng, crs=lambda: None)
    got = {(r.load_id, r.column_name, r.issue) for r in Q.issues(Q.profile(table(spark, rows), Q.RECORD_RULES)).collect()}
    assert got == {
        (10, "eo:cloud_cover", "nulls"), (11, "eo:cloud_cover", "range"), (12, "crs", "pattern"), (13, "eo:cloud_cover", "shift"),
        (14, "datetime", "range"), (15, "crs", "constant"), (None, "crs", "nulls"),
    }


def test_exact_median_with_ties_and_edges(spark):
    rng = random.Random(2)
    data = {1: [0.0], 2: [0.0, 100.0], 3: [5.0] * 7 + [6.0] * 7, 4: [round(rng.uniform(0, 100), 3) for _ in range(501)], None: [1.0, 2.0, 4.0]}
    vc = spark.createDataFrame([(l, v, 1) for l, vs in data.items() for v in vs] + [(4, 1e6, 3)], "load long, v double, n long")
    got = {r.load: r.median for r in Q.exact_median(vc, (0.0, 100.0)).collect()}
    assert got == {l: statistics.median(vs) for l, vs in data.items()}


def test_induced_expressions(spark):
    vals = [f"EPSG:{32600 + i}" for i in range(40)] + [f"AB{i}-x" for i in range(10, 40)] + ["(weird) [v]", "", "EPSG:4326", None]
    got = {r.v: r.expression for r in Q.induce_expressions(spark.createDataFrame([(v,) for v in vals], "v string")).collect()}
    assert got["EPSG:32600"] == "EPSG:[0-9]{5}" and got["EPSG:4326"] == "EPSG:[0-9]{4}" and got["AB10-x"] == "AB[0-9]{2}\\-x" and got[""] == "" and None not in got
    df = spark.createDataFrame([(k, v) for k, v in got.items()], "v string, e string")
    assert df.selectExpr("bool_and(regexp_like(v, concat('^', e, '$'))) as ok").first().ok


def test_empty_and_long(spark):
    assert Q.issues(Q.profile(table(spark, []), Q.RECORD_RULES)).count() == 0
    p = Q.profile(table(spark, [(1, None, None, "x" * 200_000), (1, None, None, None)]), Q.RECORD_RULES)
    assert {(r.column_name, r.nulls) for r in p.collect()} == {("eo:cloud_cover", 2), ("datetime", 2), ("crs", 1)}
    c = Q.coverage(table(spark, [(1, None, None, "x" * 200_000), (1, None, None, None)]), Q.RECORD_RULES[2])
    assert [(r.rows, r.conforms, r.coverage) for r in c.collect()] == [(1, 0, 1.0)] and Q.coverage(table(spark, []), Q.RECORD_RULES[2]).count() == 0


def test_conformity_of_expressions():
    p = "EPSG:[0-9]{4,5}"
    for e, want in (("EPSG:[0-9]{5}", "all"), ("EPSG:[0-9]{4,5}", "all"), ("EPSG:[0-9]{4,6}", "some"), ("EPSG:32632", "all"), (r"\p{Lu}{4}:[0-9]{4}", "some"), ("epsg:[0-9]{4}", "none"), (r"\p{Ll}{4}:[0-9]{4}", "none"), ("EPSG:[0-9]{3}", "none"), (r"EPSG:[0-9]{5}\s{1}", "none"), ("", "none")):
        assert Q.conformity(e, p) == want, e
    assert Q.conformity("EPSG:[0-9]{4}", "EPSG:(4326|3857)") == "some" and Q.conformity("[0-9]{2}", "[0-5][0-9]") == "some"


def test_rows_are_judged_by_their_expressions(spark, monkeypatch):
    rng = random.Random(4)
    vals = [f"EPSG:{rng.randrange(1000, 99999)}" for _ in range(400)] + [f"{rng.choice(['EPSG', 'ESRI', 'IGNF', 'OGCX'])}{rng.choice([':', ' ', '::'])}{rng.randrange(10, 999999)}" for _ in range(400)] + ["EPSG:4326\n", "", "wgs84"]
    ind = Q.induce_expressions(spark.createDataFrame([(v,) for v in vals], "v string")).cache()
    rows = Q.judged(ind, "EPSG:[0-9]{4,5}").collect()
    assert len(rows) == len(set(vals)) and all(r.fits == bool(re.fullmatch("EPSG:[0-9]{4,5}", r.v) and "\n" not in r.v) for r in rows)
    # the expressions decide: where one is said to conform, its values do
    monkeypatch.setattr(Q, "conformity", lambda e, p: "all")
    assert all(r.fits for r in Q.judged(ind, "EPSG:[0-9]{4,5}").collect())


def test_coverage_changes(spark):
    rng = random.Random(6)
    rows = [r for l in range(5) for r in many(l, 60, rng)] + many(7, 60, rng, crs=lambda: f"urn:{rng.randrange(10, 99)}")
    got = Q.coverage_changes(Q.coverage(table(spark, rows), Q.RECORD_RULES[2])).collect()
    odd = {(r.load_id, round(r.change, 3)) for r in got if abs(r.change) > 0.5}
    assert (7, -1.0) in odd and (7, 1.0) in odd and {l for l, _ in odd} == {7}
