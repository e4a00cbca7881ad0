import numpy as np
import pytest

from scenegrain.llm import mixing as M

DOCS = "doc_id long, text string, source string, key string, tokens string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", "clash") for i, t, s in rows], DOCS)


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, weight double, max_repeats int")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(n):
    p = M.permute(np.arange(n), n, 12345)
    assert sorted(p) == list(range(n))
    assert n < 5 or list(p) != list(M.permute(np.arange(n), n, 54321))


def test_out_of_reach(spark):
    d = docs(spark, [(i, "one two three four", " Big " if i % 2 else "BIG") for i in range(90)] + [(100, "one two", "small"), (101, None, "big"), (102, "", "small"), (103, "stray words", None)])
    t = targets(spark, [("big", 1.0, 1), ("Small", 1.0, 5), ("none", 0.5, 3), ("idle", 0.0, 1), ("bad", float("nan"), 1), ("null", None, None)])
    assert sorted(r.source for r in M.out_of_reach(d, t).collect()) == ["Small", "none"]


def test_mix_respects_shares_and_caps(spark):
    d = docs(spark, [(i, f"w{i} " * 50, "a") for i in range(400)] + [(1000 + i, f"v{i} " * 50, "b") for i in range(100)] + [(2000 + i, f"u{i} " * 50, "c") for i in range(4)])
    out, rep = M.mix(d, targets(spark, [("a", 0.5, 1), ("b", 0.4, 3), ("c", 0.1, 2)]), block=64, slots_per_shard=100)
    rep = {r.source: r for r in rep.collect()}
    assert rep["c"].out_of_reach and not rep["a"].out_of_reach and rep["c"].tokens_out <= 2 * rep["c"].tokens
    assert abs(rep["a"].actual - rep["a"].reachable) < 0.05 and abs(rep["b"].actual - rep["b"].reachable) < 0.05
    used = {}
    for r in out.collect():
        used.setdefault((r.source, r.doc_id), []).append((r.start, r["pass"]))
    for (s, _), pieces in used.items():
        assert len(pieces) == len(set(pieces)) and max(p for _, p in pieces) < {"a": 1, "b": 3, "c": 2}[s]


def test_blocks_hold_every_token_once(spark):
    s = spark.createDataFrame([(i, "a" if i % 3 else "b", i % 50) for i in range(1000)] + [(5000, None, 7)], "doc_id long, key string, tokens long")
    rows = M.blocks(s, 64, buckets=8).collect()
    fill, cover = {}, {}
    for r in rows:
        fill[r.key, r.block] = fill.get((r.key, r.block), 0) + r.length
        cover.setdefault(r.doc_id, []).append((r.start, r.length))
    for k in "ab":
        sizes = [fill[x] for x in sorted(fill) if x[0] == k]
        assert all(v == 64 for v in sizes[:-1]) and 0 < sizes[-1] <= 64
    for i, parts in cover.items():
        assert sum(n for _, n in parts) == i % 50
    assert 5000 not in cover


def test_empty(spark):
    out, rep = M.mix(docs(spark, []), targets(spark, [("a", 1.0, 1)]))
    assert out.count() == 0 and [r.actual for r in rep.collect()] == [0.0]
    out, rep = M.mix(docs(spark, [(1, "x y", "a")]), targets(spark, []))
    assert out.count() == 0 and rep.count() == 0


def test_reachable_shares():
    rows = [{"key": "a", "wanted": 0.5, "cap": 1000}, {"key": "b", "wanted": 0.5, "cap": 10}]
    assert M.reachable_shares(rows, 100) == {"b": 0.1, "a": 0.9}
