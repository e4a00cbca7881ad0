import json
from datetime import datetime

from scenegrain.operators import schema_drift as S

SCHEMA = "file_id long, file_name string, stream string, written_at timestamp_ntz, received_at timestamp_ntz, line_no int, payload string, nodata_path string"


def lines(spark, files):
    rows = []
    for fid, stream, day, payloads in files:
        t = None if day is None else datetime(2024, 1 + day // 28, 1 + day % 28)
        rows += [(fid, f"f{fid}", stream, t, t, k, p if p is None or isinstance(p, str) else json.dumps(p), "clash") for k, p in enumerate(payloads)]
    return spark.createDataFrame(rows, SCHEMA)


def found(df):
    return sorted((r.file_id, r.field, r.change) for r in S.changes(S.migrations(S.fingerprints(S.flatten(df)))).collect())


def unified(df):
    flat = S.flatten(df)
    return S.unify(flat, S.migrations(S.fingerprints(flat)))


def test_changes_between_files(spark):
    df = lines(spark, [
        (1, "a", 0, [{"nodata": 0}, {"nodata": 1}]),
        (2, "a", 40, [{"tags": {"42113": 0}}, {"tags": {"42113": 2}}]),  # another month, another path
        (3, "a", 41, [{"tags": {"42113": "0"}, "spp": 3}, {"tags": {"42113": "1"}, "spp": 3}]),
        (4, "a", 42, [{"spp": None, "nodata_count": 3}, {"spp": None}]),
        (5, "b", 1, [{"nodata": 5}]),
    ])
    assert found(df) == sorted([(2, "nodata", "renamed"), (3, "nodata", "retyped"), (3, "samples_per_pixel", "added"), (4, "nodata", "removed")])


def test_single_deviating_cut_off_and_repeated_lines_change_nothing(spark):
    good = [{"photometric": 1}] * 3
    df = lines(spark, [(1, "a", 0, good), (2, "a", 1, [*good, {"photometric": "rgb"}, '{"photometric": "1', "", None, "[1]", "7"])])
    df = df.unionByName(df.filter("line_no = 3")).unionByName(df.filter("line_no = 3"))
    assert found(df) == []


def test_nulls_in_keys_and_ties(spark):
    df = lines(spark, [(1, None, 0, [{"nodata": 1}]), (2, "a", None, [{"spp": 1}]), (3, "a", 0, [{"nodata": 1}, {"nodata": "1"}]), (4, "a", 0, [{"nodata": 1}])])
    assert found(df) == []  # a tie of kinds goes to the smaller word, "number"
    assert S.fingerprints(S.flatten(df)).count() == 4


def test_unify_rules_and_versions(spark):
    df = lines(spark, [(1, "a", 0, [{"NoData": " -9 ", "Photometric": "RGB", "extraSamples": "[1, 2]", "layout": {"samples_per_pixel": 3}}, {"nodata": "x"}]), (2, "a", 1, [{"nodata": 1, "extra_samples": 2}])])
    rows = {(r.file_id, r.line_no): r for r in unified(df).collect()}
    r = rows[1, 0]
    assert (r.nodata, r.photometric, r.extra_samples, r.samples_per_pixel) == (-9.0, 2, [1, 2], 3)
    assert "NoData" in r.renamed_from and rows[1, 1].cast_failed == ["nodata"] and rows[2, 0].extra_samples == [2]
    v = {r.file_id: r for r in S.migrations(S.fingerprints(S.flatten(df))).collect()}
    assert v[1].version == 1 and v[2].version == 2 and v[1].before is None and v[2].before == v[1].rules and v[2].starts
    rules = {x.field: x for x in v[1].rules}
    assert rules["samples_per_pixel"].rename == "layout.samples_per_pixel" and rules["extra_samples"].cast == "string" and {x.field: x.default for x in v[2].rules}["photometric"] == "null"


def test_lines_go_through_the_rules_of_their_version(spark):
    df = lines(spark, [(1, "a", 0, [{"spp": 3}, {"spp": 3}, {"samplesPerPixel": "4"}, {}, "cut{"]), (2, None, None, [{"spp": "5"}]), (None, "a", 1, [{"spp": 6}])])
    flat = S.flatten(df)
    m = S.migrations(S.fingerprints(flat))
    rows = {(r.file_id, r.line_no): r for r in S.unify(flat, m).collect()}
    assert len(rows) == 7 and [rows[k].samples_per_pixel for k in ((1, 0), (1, 2), (1, 3), (2, 0), (None, 0))] == [3, 4, None, 5, 6]
    assert rows[1, 0].version == 1 and rows[1, 0].renamed_from == ["spp"] and rows[1, 0].deviates == []
    assert rows[1, 2].renamed_from == ["samplesPerPixel"] and rows[1, 2].deviates == ["samples_per_pixel"] == rows[1, 3].deviates and rows[1, 4].deviates == []
    assert rows[2, 0].version is None and rows[2, 0].deviates == [] and rows[None, 0].version is None
    # the renames come from the rules: without them the lines that keep to their version have none
    from pyspark.sql import functions as F
    bare = m.withColumn("rules", F.transform("rules", lambda r: r.withField("rename", F.lit(None).cast("string"))))
    assert {(r.file_id, r.line_no): r for r in S.unify(flat, bare).collect()}[1, 0].deviates == ["samples_per_pixel"]


def test_nested_in_lists(spark):
    df = lines(spark, [(1, "a", 0, [{"nodata": 1}]), (2, "a", 1, [{"bands": [3, {"deep": {"NoData": 1}}]}])])
    assert found(df) == [(2, "nodata", "renamed")]


def test_empty_and_very_long(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found(empty) == [] and unified(empty).count() == 0
    df = lines(spark, [(1, "a", 0, [{"nodata": 1}]), (2, "a", 1, [{"gdal": {"nodata": 1}, "pad": "x" * 2_000_000}])])
    assert found(df) == [(2, "nodata", "renamed")]
