"""The k most similar vectors of every vector (problem 3) by an inverted multi-index.

Unit vectors are cut into two halves; each half is quantised by its own codebook, so that a vector lies in the
cell of a pair of centroids. A query walks the pairs by ascending summed distance with a heap until the cells
hold enough entries, and the entries of the walked cells are reranked by their cosine similarity.

The codebooks are fitted on at most ``sample`` vectors (those with the smallest hash of their id); every vector
is indexed. The entries are written once to the shared folder in order of their cells. A task takes a block of
queries, walks the index for each, and reads the written entries past them in batches, so nothing that is
walked is shuffled, and no task grows with a hot cell: that is more batches, and its queries more blocks.

Without a least similarity, what a query walks grows with the table (``share``), so that recall doesn't fall as the table
grows denser. With one, a query walks every cell in reach, however many entries they hold: its partners lie within a known
distance, and so does what divides their cell from its own. Where all vectors ask, each walked pair answers both, so
that one of both has to reach the other. ``exact`` walks everything. A cell is walked whole, however large it is.

Defined cases
  * Valid is a vector of ``dim`` finite values, none null or ``nodata``, not all zero; others neither ask nor answer.
  * Copies are searched once and put back for the result: equal similarities go to the smaller id.
  * The scale of a vector doesn't matter. Fewer than k other vectors (or than reach ``min_similarity``): fewer rows.
  * An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenegrain.llm.files import parquet_file
from scenegrain.session import settled


@dataclass(frozen=True)
class Index:
    """Parameters. ``occupancy``: wanted vectors a cell, which sets the number of centroids (at most ``max_centroids``);
    ``candidates`` and ``share``: entries a query walks at least, and the share of all entries that it walks at least, where no least similarity
    is asked for; ``reach``: where one is, the part of the distance between vectors of that similarity that may lie across the bisectors of
    their cells' centroids: at 1 nothing can be missed, at 0.4 that is 3.2 standard deviations of partners in random directions of 64;
    ``exact``: walk all entries; ``block``: queries that a task takes at a time; ``batch``: entries that it reads at a time; ``walked``: cells
    of queries that it holds at a time; ``reach_centroids``: at most so many centroids where a least similarity is asked for, as beyond them
    visiting ever more cells takes longer than the entries that they spare."""

    dim: int = 64
    nodata: float = -128.0
    sample: int = 20_000
    occupancy: float = 32.0
    max_centroids: int = 1024
    candidates: int = 3_000
    share: float = 1 / 19
    reach: float = 0.4
    exact: bool = False
    block: int = 65_536
    batch: int = 8_192
    walked: int = 10_000_000
    reach_centroids: int = 448
    rounds: int = 8


def valid_units(vectors: DataFrame, id_col: str, data: str, ix: Index) -> DataFrame:
    """Rows (id, unit): valid vectors scaled to length 1."""
    d = F.col(data)
    src = vectors.filter(F.col(id_col).isNotNull() & d.isNotNull() & (F.size(d) == ix.dim)).select(F.col(id_col).cast("long").alias("id"), d.cast("array<double>").alias("d"))

    def run(batches):
        for b in batches:
            flat = b.column(1).flatten()
            x = flat.to_numpy(zero_copy_only=False).astype("f8").reshape(b.num_rows, ix.dim)  # null becomes NaN
            ok = (np.isfinite(x) & (x != ix.nodata)).all(axis=1) & (x != 0).any(axis=1)
            x = x[ok]
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("<f4")
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "unit"])

    return src.mapInArrow(run, "id long, unit binary")


def _matrix(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The rows of a column of equally long texts of 4-byte floats, without a copy."""
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if not len(a):
        return np.empty((0, dim), "<f4")
    first = np.frombuffer(a.buffers()[1], "<i4")[a.offset]
    return np.frombuffer(a.buffers()[2], "<f4", len(a) * dim, int(first)).reshape(-1, dim)


def _sq(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


def _codebook(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Lloyd's algorithm from spread-out starts; deterministic."""
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([_sq(part, c).argmin(1) for part in np.array_split(x, max(1, len(x) // 4096))])
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return c.astype("f4")


def walk(d1: np.ndarray, d2: np.ndarray, counts: list[list[int]], enough: int) -> list[tuple[int, int]]:
    """Centroid pairs by ascending summed distance, with a heap, until their cells hold ``enough`` entries. ``counts``: entries by pair."""
    o1, o2 = np.argsort(d1), np.argsort(d2)
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    o1, o2 = o1.tolist(), o2.tolist()
    heap, held, out = [(s1[0] + s2[0], 0, 0)], 0, []
    k1, k2 = len(s1), len(s2)
    pop, push, swap = heapq.heappop, heapq.heappush, heapq.heapreplace
    while heap and held < enough:
        _, i, j = heap[0]
        a, b = o1[i], o2[j]
        n = counts[a][b]
        if n:
            out.append((a, b))
            held += n
        # (i, j + 1) follows (i, j); (i + 1, 0) follows (i, 0): each pair enters the heap once
        if j + 1 < k2:
            swap(heap, (s1[i] + s2[j + 1], i, j + 1))
        else:
            pop(heap)
        if j == 0 and i + 1 < k1:
            push(heap, (s1[i + 1] + s2[0], i + 1, 0))
    return out


def across(d: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Squared distances of queries from the bisectors between their nearest centroid and each other one. ``d``: squared distances from the
    centroids, ``apart``: those between centroids. What lies nearest to the other centroid is at least as far from the query."""
    near = d.argmin(axis=1)
    gap, apart = d - d[np.arange(len(d)), near][:, None], apart[near]
    return np.divide(gap * gap, 4 * apart, out=np.zeros_like(gap), where=apart > 0)


def within(t1: np.ndarray, t2: np.ndarray, filled: np.ndarray, limit: float) -> np.ndarray:
    """The cells (numbered by pair) with entries whose bisectors are within ``limit`` (squared). ``filled``: whether a cell has entries."""
    i, j = np.flatnonzero(t1 <= limit), np.flatnonzero(t2 <= limit)
    cells = (i[:, None] * len(t2) + j)[t1[i][:, None] + t2[j] <= limit]
    return cells[filled[cells]].astype("i4")


def _best(q: np.ndarray, e: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` most similar rows of each ``q``; equal similarities go to the smaller ``e``."""
    o = np.lexsort((e, -s, q))
    q, e, s = q[o], e[o], s[o]
    top = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[top], e[top], s[top]


def search(qid: np.ndarray, qm: np.ndarray, wanted: list[np.ndarray], entries, k: int, min_similarity: float, ix: Index, both: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, similarity) of the ``k`` best entries of each query, from batches (id, matrix, cell) in order of cells.

    ``wanted``: the cells that each query walks; emptied. ``both``: also, for each walked entry, the ``k`` best of the queries that walk it.
    """
    pairs = np.concatenate(wanted).astype("i8") << 32
    pairs |= np.repeat(np.arange(len(qid), dtype="i4"), [len(w) for w in wanted])
    pairs.sort()
    wanted.clear()  # the sorted pairs of cell and query are the largest thing held
    least = max(min_similarity, -1.0) - 1e-5
    best = np.full((len(qid), k), -np.inf, "f4")  # the k best so far, which set the floor
    floor = np.full(len(qid), least, "f4")
    found: list[list[np.ndarray]] = [[], [], []]
    back: list[list[np.ndarray]] = [[], [], []]
    for eid, em, cell in entries:
        starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.empty(0, "i8")
        ends = np.append(starts[1:], len(cell))
        key = cell[starts].astype("i8")
        lo, hi = np.searchsorted(pairs, key << 32), np.searchsorted(pairs, (key + 1) << 32)
        some = lo < hi
        for a, b, l, r in zip(*(v[some].tolist() for v in (starts, ends, lo, hi))):
            for at in range(l, r, 2048):
                rows = pairs[at : min(at + 2048, r)].astype("i4")  # the lower half
                sim = em[a:b] @ qm.take(rows, axis=0).T  # entries first: maxima over a short last axis are slow
                if sim.max() < least:
                    continue
                high = np.flatnonzero(sim.max(axis=0) >= (least if both else floor[rows]))
                if not len(high):
                    continue
                rows, sim = rows[high], sim[:, high].T
                sim[qid[rows][:, None] == eid[None, a:b]] = -np.inf
                if both:
                    part = sim if len(rows) <= k else np.where(sim >= np.partition(sim, len(rows) - k, axis=0)[len(rows) - k] - 1e-5, sim, -np.inf)
                    y, z = np.nonzero(part >= least)
                    exact = np.einsum("ij,ij->i", em[a + z].astype("f8"), qm[rows[y]].astype("f8"))
                    for o, v in zip(back, _best(eid[a + z], qid[rows[y]], exact, k)):
                        o.append(v)
                    high = np.flatnonzero(sim.max(axis=1) >= floor[rows])
                    if not len(high):
                        continue
                    rows, sim = rows[high], sim[high]
                top = np.concatenate([best[rows], sim if b - a <= k else np.partition(sim, b - a - k, axis=1)[:, b - a - k :]], axis=1)
                best[rows] = np.partition(top, top.shape[1] - k, axis=1)[:, top.shape[1] - k :]
                floor[rows] = np.maximum(floor[rows], best[rows].min(axis=1) - 1e-5)
                y, z = np.nonzero(sim >= floor[rows][:, None])
                exact = np.einsum("ij,ij->i", qm[rows[y]].astype("f8"), em[a + z].astype("f8"))
                for o, v in zip(found, (qid[rows[y]], eid[a + z], exact)):
                    o.append(v)
    out = []
    for each in (found, back):
        if each[0]:
            q, e, s = (np.concatenate(v) for v in each)
            keep = s >= min_similarity
            out.append(_best(q[keep], e[keep], s[keep], k))
    return tuple(np.concatenate(v) for v in zip(*out)) if out else (np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0))


def nearest(units: DataFrame, k: int, ix: Index, min_similarity: float = -1.0, queries: DataFrame | None = None) -> DataFrame:
    """Rows (query, id, similarity): for each row of ``queries`` (default: all) its ``k`` most similar other rows of ``units``, which have different vectors."""
    spark = units.sparkSession
    n = units.count()
    schema = "query long, id long, similarity double"
    if n < 2:
        return spark.createDataFrame([], schema)
    # a fixed number of entries would find ever fewer of the nearest as the table grows denser
    enough = n if ix.exact else max(ix.candidates, math.ceil(n * ix.share))
    both = not ix.exact and min_similarity > -1 and queries is None
    # squared, of the distance across bisectors; that of a pair is the sum of both its sides, so one of them is within the half
    limit = None if ix.exact or min_similarity <= -1 else ix.reach**2 * (2 - 2 * min(min_similarity, 1.0)) / (2 if both else 1) + 1e-5
    half = ix.dim // 2
    fit = units.orderBy(F.xxhash64("id"), "id").limit(ix.sample).select("unit").toArrow()
    x = _matrix(fit.column(0), ix.dim)
    kc = int(min(ix.max_centroids, ix.max_centroids if limit is None else ix.reach_centroids, max(2, round((n / ix.occupancy) ** 0.5)), max(2, len(x) // 4), len(x)))
    books = [_codebook(x[:, :half], kc, ix.rounds), _codebook(x[:, half:], kc, ix.rounds)]

    apart = [_sq(c, c) for c in books]

    def assign(batches):
        for b in batches:
            m = _matrix(b.column(1), ix.dim)
            c1, c2 = (_sq(m[:, s], c).argmin(1) for s, c in zip((slice(0, half), slice(half, None)), books))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((c1 * kc + c2).astype("i4"))], names=["id", "unit", "cell"])

    cores = spark.sparkContext.defaultParallelism
    parts = cores * max(3, -(-n // (ix.block * cores)))  # a file is a block of queries
    entries = settled(spark, units.select("id", "unit").mapInArrow(assign, "id long, unit binary, cell int").repartitionByRange(parts, "cell", "id").sortWithinPartitions("cell", "id"), "entries")
    counts = np.zeros(kc * kc, "i8")  # at most max_centroids^2 cells, whatever the number of vectors
    held = entries.groupBy("cell").count().toArrow()
    counts[held.column(0).to_numpy()] = held.column(1).to_numpy()
    spans = {r[0].rpartition("/")[2]: (r[1], r[2]) for r in entries.groupBy(F.input_file_name()).agg(F.min("cell"), F.max("cell")).collect()}
    files = sorted((*spans[name], path) for path in entries.inputFiles() if (name := path.rpartition("/")[2]) in spans)  # in order of cells
    shipped = spark.sparkContext.broadcast((counts.reshape(kc, kc).tolist() if limit is None else counts > 0, files))

    def written(files: list[tuple[int, int, str]], cells: np.ndarray):
        """The entries past files and row groups without any of the cells."""
        some = lambda lo, hi: np.searchsorted(cells, lo) < np.searchsorted(cells, hi, side="right")
        for lo, hi, path in files:
            if not some(lo, hi):
                continue
            f = parquet_file(path)
            at = f.schema_arrow.get_field_index("cell")
            groups = []
            for g in range(f.num_row_groups):
                s = f.metadata.row_group(g).column(at).statistics
                if s is None or not s.has_min_max or some(s.min, s.max):
                    groups.append(g)
            if groups:
                for b in f.iter_batches(ix.batch, row_groups=groups, columns=["id", "unit", "cell"]):
                    yield b.column(0).to_numpy(), _matrix(b.column(1), ix.dim), b.column(2).to_numpy()

    def answers(t: pa.Table):
        """The answers to a block of queries; of fewer at a time where they walk very many cells."""
        cells, files = shipped.value
        qid, qm = t.column("id").to_numpy(), _matrix(t.column("unit"), ix.dim)
        wanted: list[np.ndarray] = []
        first = walked = 0
        for lo in range(0, len(qid), 1024):
            d1, d2 = _sq(qm[lo : lo + 1024, :half], books[0]), _sq(qm[lo : lo + 1024, half:], books[1])
            if limit is None:
                more = [np.array([i * kc + j for i, j in walk(a, b, cells, enough)], "i4") for a, b in zip(d1, d2)]
            else:
                more = [within(a, b, cells, limit) for a, b in zip(across(d1, apart[0]), across(d2, apart[1]))]
            wanted += more
            walked += sum(map(len, more))
            last = lo + len(more)
            if walked >= ix.walked or last == len(qid):
                own, om = qid[first:last], qm[first:last]
                some = np.zeros(kc * kc, bool)
                for w in wanted:
                    some[w] = True
                q, e, s = search(own, om, wanted, written(files, np.flatnonzero(some)), k, min_similarity, ix, both)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(e), pa.array(s)], names=["query", "id", "similarity"])
                wanted, first, walked = [], last, 0

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            for at in range(0, b.num_rows, ix.block):
                held.append(b.slice(at, ix.block))
                if sum(h.num_rows for h in held) >= ix.block:
                    yield from answers(pa.Table.from_batches(held))
                    held = []
        if held:
            yield from answers(pa.Table.from_batches(held))

    def run_files(batches):
        """The entries of whole files as queries: neighbours in order of cells, which want the same files."""
        for b in batches:
            for at in b.column(0).to_pylist():
                t = parquet_file(shipped.value[1][at][2]).read(columns=["id", "unit"])
                step = -(-t.num_rows // max(1, round(t.num_rows / ix.block)))
                for lo in range(0, t.num_rows, step):
                    yield from answers(t.slice(lo, step).combine_chunks())

    if queries is None:
        found = spark.range(0, len(files), 1, len(files)).mapInArrow(run_files, schema)
        if not both:
            return found
        found = found.repartition("query").groupBy("query", "id").agg(F.max("similarity").alias("similarity"))
        ranked = found.withColumn("n_", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id")))
        return ranked.filter(F.col("n_") <= k).drop("n_")
    return queries.select("id", "unit").mapInArrow(run, schema)


def similar(vectors: DataFrame, k: int = 5, min_similarity: float = -1.0, id_col: str = "vec_id", data: str = "data", ix: Index = Index()) -> DataFrame:
    """Rows (query, id, similarity, rank): for every valid vector its ``k`` most similar others."""
    spark = vectors.sparkSession
    marked = valid_units(vectors, id_col, data, ix).withColumn("h", F.md5("unit"))
    # one row a set of copies, by its smallest id
    reps = settled(spark, marked.groupBy("h").agg(F.min(F.struct("id", "unit")).alias("r"), F.count("*").alias("n")).select("h", "r.id", "r.unit", "n"), "units")
    own = marked.select("id", "h").join(reps.filter("n > 1").select("h", F.col("id").alias("rep")), "h").select("id", "rep")
    own = settled(spark, own, "copies")
    found = nearest(reps.select("id", "unit"), k, ix, min_similarity)
    single = reps.filter("n = 1").select("id", F.col("id").alias("rep"))
    # Of each set of copies the k + 1 smallest ids can be among anyone's k nearest.
    head = own.withColumn("n_", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).filter(F.col("n_") <= k + 1).select(F.col("rep").alias("to"), F.col("id").alias("other"))
    head = head.unionByName(single.select(F.col("rep").alias("to"), F.col("id").alias("other")))
    between = found.select(F.col("query").alias("rep"), F.col("id").alias("to"), "similarity")
    within = reps.filter("n > 1").select(F.col("id").alias("rep"), F.col("id").alias("to"), F.lit(1.0).alias("similarity"))
    rows = between.unionByName(within).join(head, "to").join(own.unionByName(single), "rep").filter("id <> other")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other")))
    return ranked.filter(F.col("rank") <= k).select(F.col("id").alias("query"), F.col("other").alias("id"), "similarity", "rank")


def similar_pairs(vectors: DataFrame, k: int = 5, min_similarity: float = 0.9, **kw) -> DataFrame:
    """Distinct (vec_a, vec_b), smaller first, where one is among the other's ``k`` most similar and they reach ``min_similarity``."""
    s = similar(vectors, k, min_similarity, **kw)
    return s.select(F.least("query", "id").alias("vec_a"), F.greatest("query", "id").alias("vec_b")).distinct()
