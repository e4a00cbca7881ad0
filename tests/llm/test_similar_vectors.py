import numpy as np

from scenegrain.llm import similar_vectors as V

SCHEMA = "vec_id long, data array<float>, id long, query string, unit string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if d is None else [None if x is None else float(x) for x in d], 7, "clash", "clash") for i, d in rows], SCHEMA)


def clustered(seed, groups=120, size=8):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        c = rng.normal(size=64)
        out += [(c + rng.normal(size=64) * 0.15) * rng.uniform(0.01, 100) for _ in range(rng.integers(1, size))]
    return list(enumerate(out))


def brute(rows, k, least):
    ids = np.array([i for i, _ in rows])
    x = np.array([d for _, d in rows]).astype("f4").astype("f8")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    out = set()
    for a in range(len(ids)):
        for b in sorted(range(len(ids)), key=lambda b: (-round(s[a, b], 7), ids[b]))[:k]:
            if s[a, b] >= least:
                out.add((int(ids[a]), int(ids[b])))
    return out


def test_recall_against_brute_force(spark):
    rows = clustered(1)
    ix = V.Index(candidates=120, occupancy=8)
    want = brute(rows, 5, -1)
    got = {(r.query, r.id) for r in V.similar(table(spark, rows), 5, ix=ix).collect()}
    assert len(got & want) / len(want) > 0.9
    pairs = {(min(p), max(p)) for p in brute(rows, 5, 0.9)}
    found = {(r.vec_a, r.vec_b) for r in V.similar_pairs(table(spark, rows), 5, 0.9, ix=ix).collect()}
    assert len(found & pairs) / len(pairs) > 0.97 and len(found - pairs) <= 0.01 * len(pairs)


def test_blocks_and_batches_change_nothing(spark):
    rows = clustered(2, groups=40)
    small, large = V.Index(exact=True, block=16, batch=7), V.Index(candidates=10_000)
    a, b = ({(r.query, r.id) for r in V.similar(table(spark, rows), 5, ix=ix).collect()} for ix in (small, large))
    assert a == b == brute(rows, 5, -1)


def test_a_dense_region_is_walked_whole(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=64)
    dense = [centre + rng.normal(size=64) * 0.02 * rng.uniform(0.5, 1) + rng.normal(size=64).cumsum() * 0.02 for _ in range(1200)]
    rows = list(enumerate(dense)) + [(5000 + i, v) for i, v in clustered(6, groups=300)]
    got = {(r.query, r.id) for r in V.similar(table(spark, rows), 5, ix=V.Index(candidates=400, occupancy=60, rounds=5, block=500)).collect()}
    want = brute(rows, 5, -1)
    assert len(got & want) / len(want) > 0.9 and len({q for q, _ in got}) == len(rows)


def test_copies_ties_and_dirt(spark):
    v, w = np.arange(1.0, 65.0), np.concatenate([np.ones(32), -np.ones(32)])
    rows = [(i, v) for i in range(1, 10)] + [(20, w), (21, w * 2)]
    rows += [(30, None), (31, []), (32, v[:63]), (33, np.append(v, 1)), (34, [None, *v[1:]]), (35, [float("nan"), *v[1:]]), (36, [-128.0, *v[1:]]), (37, np.zeros(64)), (38, [float("inf"), *v[1:]]), (None, v)]
    got = {}
    for r in V.similar(table(spark, rows), 3, 0.9, ix=V.Index(candidates=100)).collect():
        got.setdefault(r.query, []).append((r.rank, r.id))
    assert {q: [i for _, i in sorted(x)] for q, x in got.items()} == {**{1: [2, 3, 4], 2: [1, 3, 4], 3: [1, 2, 4]}, **{q: [1, 2, 3] for q in range(4, 10)}, 20: [21], 21: [20]}


def test_empty_and_single(spark):
    assert V.similar_pairs(table(spark, [])).count() == 0
    assert V.similar_pairs(table(spark, [(1, np.ones(64)), (2, None)])).count() == 0
    assert V.similar_pairs(table(spark, [(1, np.ones(64)), (2, np.ones(64) * 3)])).collect()[0][:] == (1, 2)


def test_walk_takes_pairs_in_order_of_summed_distance():
    rng = np.random.default_rng(0)
    d1, d2, counts = rng.random(7), rng.random(9), rng.integers(0, 3, (7, 9))
    cells = V.walk(d1, d2, counts.tolist(), 10**9)
    assert set(cells) == {(int(i), int(j)) for i, j in zip(*np.nonzero(counts))} and len(cells) == len(set(cells))
    sums = [d1[i] + d2[j] for i, j in cells]
    assert sums == sorted(sums)


def test_recall_holds_as_the_table_grows(spark):
    rng = np.random.default_rng(11)
    mix = rng.normal(size=(12, 64))  # vectors that lie near a subspace, as embeddings do

    def recall(n, ix):
        x = (rng.normal(size=(n, 12)) @ mix + 0.3 * rng.normal(size=(n, 64))).astype("f4")
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        units = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(x)], "id long, unit binary").repartition(4)
        sim = x[:100] @ x.T
        sim[np.arange(100), np.arange(100)] = -2
        want = [set(np.argsort(-s)[:5].tolist()) for s in sim]
        got = {}
        for r in V.nearest(units, 5, ix, queries=units.filter("id < 100")).collect():
            got.setdefault(r.query, set()).add(r.id)
        return sum(len(w & got.get(i, set())) for i, w in enumerate(want)) / 500

    grown = [recall(n, V.Index(candidates=500)) for n in (2_000, 20_000)]
    assert min(grown) > 0.9
    assert recall(4_000, V.Index(candidates=20, exact=True)) == 1


def test_with_a_least_similarity_cells_in_reach_are_walked_not_a_share(spark):
    rows = clustered(12, groups=250)
    want = {(min(p), max(p)) for p in brute(rows, 5, 0.9)}
    # counts neither cut the walk short nor draw it out; partners across bisectors are found at full reach, whatever the cells
    few = V.Index(candidates=1, share=1e-9, occupancy=2, reach=1)
    assert {(r.vec_a, r.vec_b) for r in V.similar_pairs(table(spark, rows), 5, 0.9, ix=few).collect()} == want
    few = V.Index(candidates=1, share=1e-9, occupancy=2, block=100, batch=30, walked=500)
    found = {(r.vec_a, r.vec_b) for r in V.similar_pairs(table(spark, rows), 5, 0.9, ix=few).collect()}
    assert len(found & want) / len(want) > 0.995 and not found - {(min(p), max(p)) for p in brute(rows, 8, 0.9)}


def test_the_part_of_a_larger_table_in_reach_is_smaller():
    rng = np.random.default_rng(13)
    mix = rng.normal(size=(12, 64))
    x = (rng.normal(size=(20_000, 12)) @ mix + 0.3 * rng.normal(size=(20_000, 64))).astype("f4")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    parts = []
    for n in (2_000, 20_000):  # as many cells as the table has room for
        kc = round((n / 32) ** 0.5)
        books = [V._codebook(x[:n, h], kc, 8) for h in (slice(0, 32), slice(32, 64))]
        near = [V._sq(x[:n, h], c).argmin(1) for h, c in zip((slice(0, 32), slice(32, 64)), books)]
        counts = np.bincount(near[0] * kc + near[1], minlength=kc * kc)
        t1, t2 = (V.across(V._sq(x[:200, h], c), V._sq(c, c)) for h, c in zip((slice(0, 32), slice(32, 64)), books))
        parts.append(np.mean([counts[V.within(a, b, counts > 0, 0.4**2 * 0.2 / 2)].sum() / n for a, b in zip(t1, t2)]))
    assert parts[1] < parts[0] / 2 and parts[1] < 1 / 19


def test_both_sides_of_a_walked_pair_get_their_best():
    rng = np.random.default_rng(14)
    x = rng.normal(size=(60, 64)).astype("f4") * 0.2 + 1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    qid, eid = np.arange(20), np.arange(20, 60)
    q, e, _ = V.search(qid, x[:20], [np.array([3], "i4")] * 20, iter([(eid[:25], x[20:45], np.full(25, 3)), (eid[25:], x[45:], np.full(15, 3))]), 5, 0.0, V.Index(), True)
    got, s = set(zip(q.tolist(), e.tolist())), x.astype("f8") @ x.T.astype("f8")
    want = {(i, 20 + int(j)) for i in range(20) for j in np.argsort(-s[i, 20:])[:5]} | {(20 + j, int(i)) for j in range(40) for i in np.argsort(-s[20 + j, :20])[:5]}
    assert got == want
