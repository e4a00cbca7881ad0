"""Splits that keep related records together (problem 6).

Records and the entities they share form a bipartite graph; ``components`` labels its groups by iterative
minimum-label propagation. For footprints the entities are grid cells that a footprint covers wholly, of a size
in proportion to the footprint. A footprint also knows the larger cells around its own: whoever covers one of those shares
its ground. So any number of footprints over the same ground are joined without a pair. After that single shared areas are
tested exactly, only between groups that are still apart and whose boxes overlap. ``assign_splits`` then gives whole groups
to the splits, near the wanted shares and with each split's labels distributed like the whole.

Defined cases
  * Footprints that are missing, empty or unreadable belong to no group; such records are groups of their own for the assignment.
  * A common edge, or shared ground thinner than 1e-6 degrees, doesn't join records.
  * Split names count by meaning: case, outer blanks and the spellings in ``SPELLINGS``; any other text and null are none.
  * Repeated deliveries of a record are one record; it has all the splits its deliveries name.
  * Equal positions in the assignment are told apart by group id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenegrain.functions import polygons, wkb
from scenegrain.operators.joins import salted_join
from scenegrain.operators.spatial import footprints
from scenegrain.session import cut, settled, spread

# How the three splits are spelt.
SPELLINGS = {
    "train": ("train", "training", "tr", "trn"),
    "val": ("val", "valid", "validation", "dev"),
    "test": ("test", "testing", "tst"),
}


def split_meaning(c: Column) -> Column:
    s = F.lower(F.regexp_replace(c, r"^[\s_\-.]+|[\s_\-.]+$", ""))
    out = F.lit(None).cast("string")
    for name, words in SPELLINGS.items():
        out = F.when(s.isin(*words), F.lit(name)).otherwise(out)
    return out


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Rows (record, label): the smallest record of each record's group, from distinct (record, entity) rows.

    Each round gives an entity the least label of its records and a record the least of its entities, both
    combined before the shuffle, so an entity of a third of all records is no burden; then each label is
    replaced by its own record's label, which halves the length of chains. Rounds are cut by checkpoints.
    """
    e = settled(edges.sparkSession, edges.select("record", "entity").filter("record IS NOT NULL AND entity IS NOT NULL").distinct(), "edges")
    labels = cut(e.groupBy("record").agg(F.min("record").alias("label")))
    for _ in range(max_rounds):
        best = e.join(labels.select("record", "label"), "record").groupBy("entity").agg(F.min("label").alias("label"))
        new = e.join(best, "entity").groupBy("record").agg(F.min("label").alias("label"))
        hop = new.select(F.col("record").alias("label"), F.col("label").alias("further"))
        new = new.join(hop, "label", "left").select("record", F.least("label", F.coalesce("further", "label")).alias("label"))
        # the label before is written beside the new one, so that the test of the end reads what is written
        new = cut(new.join(labels.select("record", F.col("label").alias("was")), "record"))
        done = new.filter("label <> was").limit(1).count() == 0
        labels = new
        if done:
            return labels.select("record", "label")
    raise RuntimeError(f"labels still change after {max_rounds} rounds")


def _per_region(regs: DataFrame, schema: str, rows):
    names = [x.split()[0] for x in schema.split(", ")]
    types = [{"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[x.split()[1]] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in names]
            for key, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for row in rows(key, wkb.parse(g)):
                    for c, v in zip(out, row):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return spread(regs.select("region", "geometry"), "region").mapInArrow(run, schema)


#: Cells of a footprint: about this many a side.
ACROSS = 8
#: Levels of the grid on which boxes meet: sides of 2^level degrees, each eight times the one before.
BOX_LEVELS = tuple(range(-9, 10, 3))


def _cover(key: int, p) -> list[tuple[int, int, int, int, bool]]:
    """(region, level, cx, cy, covers) of the cells that the region covers, and of those around them up to the Earth's size, which it doesn't."""
    x0, y0, x1, y1 = wkb.bounds(p)
    level = polygons.level_of(max(x1 - x0, y1 - y0) / ACROSS)
    cells = set(polygons.covered_cells(p, level))
    out = [(key, level, cx, cy, True) for cx, cy in cells]
    while level < 9 and cells:
        level += 1
        cells = {(cx >> 1, cy >> 1) for cx, cy in cells}
        out += [(key, level, cx, cy, False) for cx, cy in cells]
    return out


def _boxes(key: int, p) -> list[tuple]:
    """(region, level, cx, cy, home, box) of each part of a region: at home on the least level whose cells are as large as the part, and seen on all above."""
    out = set()
    for rings in p:
        x0, y0, x1, y1 = wkb.bounds([rings])
        own = next((l for l in BOX_LEVELS if 2.0**l >= max(x1 - x0, y1 - y0)), BOX_LEVELS[-1])
        for l in BOX_LEVELS:
            if l >= own:
                side = 2.0**l
                out.update((key, l, cx, cy, l == own, x0, y0, x1, y1) for cx in range(int(x0 // side), int(x1 // side) + 1) for cy in range(int(y0 // side), int(y1 // side) + 1))
    return sorted(out)


def shared_ground(regs: DataFrame, thinnest: float = 1e-6) -> DataFrame:
    """Rows (region, group): groups of regions that share ground, and so on from region to region."""
    spark = regs.sparkSession
    regs = settled(spark, regs.select("region", "geometry"), "regions")
    cells = settled(spark, _per_region(regs, "region long, level long, cx long, cy long, covers boolean", _cover), "cover")
    place = ["level", "cx", "cy"]
    # a cell joins those that know it if any of them covers it; one that only one knows joins none
    joins = cells.groupBy(*place).agg(F.max("covers").alias("any"), F.min("region").alias("a"), F.max("region").alias("b")).filter("any AND a < b").select(*place)
    covered = salted_join(cells, joins, place).select(F.col("region").alias("record"), F.xxhash64(*place).alias("entity"))
    alone = regs.select(F.col("region").alias("record"), F.xxhash64(F.lit("region"), "region").alias("entity"))
    first = components(covered.unionByName(alone))

    box = _per_region(regs, "region long, level long, cx long, cy long, home boolean, x0 double, y0 double, x1 double, y1 double", _boxes)
    box = settled(spark, box.join(first.withColumnRenamed("record", "region"), "region"), "boxes")
    # Of the groups in a cell one box each; only groups that are apart meet, at least one of them at home.
    sides = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    held = box.groupBy(*place, "label", "home").agg(*sides)
    mixed = held.groupBy(*place).agg(F.min("label").alias("l"), F.max("label").alias("m"), F.max("home").alias("h")).filter("l < m AND h").select(*place)
    held = settled(spark, held.join(mixed, place), "held")
    name = lambda df, s: df.select(*place, *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c not in place])
    overlap = (F.least("x1_a", "x1_b") - F.greatest("x0_a", "x0_b") > thinnest) & (F.least("y1_a", "y1_b") - F.greatest("y0_a", "y0_b") > thinnest)
    apart = salted_join(name(held, "b"), name(held.filter("home"), "a"), place).filter((F.col("label_a") != F.col("label_b")) & overlap & (~F.col("home_b") | (F.col("label_a") < F.col("label_b"))))
    apart = settled(spark, apart.select(*place, "label_a", "label_b", "home_b", *[f"{c}_b" for c in ("x0", "y0", "x1", "y1")]), "apart")
    # The regions of two such groups in the cell whose boxes overlap: first those of one that reach the other's box.
    reach = salted_join(name(box.filter("home").drop("home"), "a"), apart, [*place, "label_a"]).filter(overlap).select(*place, "label_b", "home_b", "region_a", "label_a", *[f"{c}_a" for c in ("x0", "y0", "x1", "y1")])
    near = salted_join(name(box, "b"), reach, [*place, "label_b", "home_b"]).filter(overlap).select("region_a", "region_b", "label_a", "label_b").distinct()
    ga, gb = (regs.select(F.col("region").alias(f"region_{s}"), F.col("geometry").alias(f"geometry_{s}")) for s in "ab")

    def test(batches):
        for batch in batches:
            memo: dict[bytes, list] = {}
            read = lambda g: memo.setdefault(g, wkb.parse(g)) if len(memo) < 20_000 else wkb.parse(g)
            hit = [polygons.shared_thickness(read(x), read(y)) > thinnest for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(hit, pa.bool_())), batch.column(1).filter(pa.array(hit, pa.bool_()))], names=["label_a", "label_b"])

    pairs = near.join(ga, "region_a").join(gb, "region_b").select("label_a", "label_b", "geometry_a", "geometry_b")
    links = spread(pairs, "geometry_a", "geometry_b").mapInArrow(test, "label_a long, label_b long")
    links = settled(spark, links.distinct(), "links")
    if links.isEmpty():
        return first.select(F.col("record").alias("region"), F.col("label").alias("group"))
    pair = F.xxhash64(F.lit("link"), "label_a", "label_b").alias("entity")
    second = components(links.select(F.col("label_a").alias("record"), pair).unionByName(links.select(F.col("label_b").alias("record"), pair)))
    j = first.join(second.select(F.col("record").alias("label"), F.col("label").alias("top")), "label", "left")
    return j.select(F.col("record").alias("region"), F.coalesce("top", "label").alias("group"))


def record_groups(records: DataFrame, id_col: str = "fid") -> DataFrame:
    """Rows (id, group) of the records that have a readable footprint. A record with several footprints ties their groups together."""
    prints, regs = footprints(records, id_col)
    member = settled(records.sparkSession, prints, "members")
    rows = settled(records.sparkSession, salted_join(member, shared_ground(regs), ["region"]).select("id", "group").distinct(), "rows")
    several = rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    between = rows.join(several, "id", "left_semi").select(F.col("group").alias("record"), F.xxhash64("id").alias("entity"))
    if between.isEmpty():
        return rows
    tied = components(between)
    j = rows.join(tied.select(F.col("record").alias("group"), "label"), "group", "left")
    return j.select("id", F.coalesce("label", "group").alias("group")).distinct()


def torn_groups(records: DataFrame, id_col: str = "fid", split: str = "split") -> DataFrame:
    """Rows (id, group) of the groups whose records name more than one split."""
    groups = settled(records.sparkSession, record_groups(records, id_col), "groups")
    named = records.select(F.col(id_col).alias("id"), split_meaning(F.col(split)).alias("s")).filter("s IS NOT NULL").distinct()
    torn = groups.join(named, "id").groupBy("group").agg(F.min("s").alias("a"), F.max("s").alias("b")).filter("a <> b").select("group")
    return groups.join(torn, "group", "left_semi")


def _chi(have: np.ndarray, want: np.ndarray) -> float:
    """How far rows per split and label are from those wanted: squares over what is wanted."""
    return float(((have - want) ** 2 / np.maximum(want, 1.0)).sum())


def _gains(flat: np.ndarray, n: np.ndarray, of: np.ndarray, groups: int, at: np.ndarray, have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """[group, split]: by how much the deviation grows if the group (rows ``n`` of labels ``flat``, in split ``at``) moves to the split; 0 for its own."""
    w, d = np.maximum(want, 1.0), have - want
    come = (n[:, None] ** 2 + 2 * n[:, None] * d[:, flat].T) / w[:, flat].T
    own = at[of]
    go = (n**2 - 2 * n * d[own, flat]) / w[own, flat]
    out = np.zeros((groups, len(want)))
    np.add.at(out, of, come + go[:, None])
    out[np.arange(groups), at] = 0
    return out


def assign_splits(members: DataFrame, targets: DataFrame, group: str = "group", label: str = "label", buckets: int = 4096, strata: int = 256, at_once: int = 4096, rounds: int = 4) -> DataFrame:
    """Rows (group, split, rows): each group whole in one split, near the shares of ``targets`` (split, share), with the labels of each split distributed like the whole.

    What is minimised is the deviation of rows per split and label from the wanted ones (``_chi``). The ``at_once`` largest groups are
    placed one by one, largest first, each where it adds least. The others are stratified by their most frequent label: in each
    stratum they line up by hash, and their running share of the rows decides the split, against what the large ones left open.
    Then ``rounds`` times the ``at_once`` moves that lower the deviation most are tried one by one, each on what the ones before left,
    and carried out if they still lower it; so the deviation never grows. Labels beyond the ``strata`` most frequent count as one.
    Only ``at_once`` groups, and sums per label and bucket (at most ``strata`` x ``buckets`` rows), are ever brought together.
    """
    spark = members.sparkSession
    share = targets.filter("split IS NOT NULL AND share > 0").groupBy("split").agg(F.sum("share").alias("share"))
    wanted = {r.split: r.share for r in share.orderBy("split").collect()}  # one row per split
    if not wanted:
        raise ValueError("targets name no split with a share above 0")
    splits = sorted(wanted)
    shares = np.array([wanted[k] for k in splits]) / sum(wanted.values())
    lab = F.coalesce(F.col(label).cast("string"), F.lit(""))
    per = members.groupBy(F.col(group).alias("group"), lab.alias("label")).agg(F.count("*").alias("n"))
    often = per.groupBy("label").agg(F.sum("n").alias("rows")).orderBy(F.desc("rows"), "label").limit(strata).collect()
    number = {r.label: i for i, r in enumerate(often)}
    rest_no = len(number)
    codes = spark.createDataFrame([(r.label, number[r.label]) for r in often], "label string, code int")
    per = per.join(F.broadcast(codes), "label", "left").groupBy("group", F.coalesce("code", F.lit(rest_no)).alias("code")).agg(F.sum("n").alias("n"))
    size = per.groupBy("group").agg(F.sum("n").alias("rows"), F.max(F.struct("n", "code"))["code"].alias("stratum"), F.sort_array(F.collect_list(F.struct("code", "n"))).alias("labels"))
    size = settled(spark, size, "sizes")  # at most ``strata`` + 1 labels a group
    totals = np.zeros(rest_no + 1)
    for r in per.groupBy("code").agg(F.sum("n").alias("n")).collect():
        totals[r.code] = r.n
    want = shares[:, None] * totals[None, :]
    have = np.zeros_like(want)
    placed: list[tuple] = []
    for r in size.orderBy(F.desc("rows"), "group").limit(at_once).collect():
        code, n = (np.array([x[i] for x in r.labels]) for i in (0, 1))
        cost = [((n**2 + 2 * n * (have - want)[k, code]) / np.maximum(want[k, code], 1.0)).sum() for k in range(len(splits))]
        k = int(np.argmin(cost))
        have[k, code] += n
        placed.append((r.group, splits[k]))
    bounds = []
    for s in range(len(totals)):
        room = np.maximum(want[:, s] - have[:, s], 0.0)
        upto = np.append(0.0, np.cumsum(room / (room.sum() or 1.0)))
        bounds += [(s, k, float(upto[i]), float(upto[i + 1])) for i, k in enumerate(splits) if room.sum() > 0]
    kind = size.schema["group"].dataType.simpleString()
    fixed = spark.createDataFrame(placed, f"group {kind}, split string")
    limits = spark.createDataFrame(bounds, "stratum_ int, split string, lo double, hi double")
    rest = size.join(fixed.select("group"), "group", "left_anti").withColumn("h", F.xxhash64("group")).withColumn("b", F.pmod("h", F.lit(buckets)))
    sums = rest.groupBy("stratum", "b").agg(F.sum("rows").alias("n"))
    before = sums.select("stratum", "b", (F.sum("n").over(Window.partitionBy("stratum").orderBy("b")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("stratum")).alias("all"))
    inner = F.sum("rows").over(Window.partitionBy("stratum", "b").orderBy("h", "group")) - F.col("rows")
    at = rest.withColumn("inner", inner).join(before, ["stratum", "b"]).withColumn("at", (F.col("before") + F.col("inner") + F.col("rows") / 2) / F.col("all"))
    last = F.col("hi") >= 1 - 1e-9
    small = at.join(limits, (F.col("stratum") == F.col("stratum_")) & (F.col("at") >= F.col("lo")) & ((F.col("at") < F.col("hi")) | (last & (F.col("lo") < F.col("hi")))))
    # a stratum that the large groups have filled everywhere goes where most rows are wanted
    full = rest.join(small.select("group"), "group", "left_anti").select("group", F.lit(splits[int(shares.argmax())]).alias("split"), "rows", "labels")
    now = small.select("group", "split", "rows", "labels").unionByName(full).unionByName(size.join(fixed, "group").select("group", "split", "rows", "labels"))
    now = settled(spark, now, "assigned")
    for _ in range(rounds):
        have = np.zeros_like(want)
        for r in now.select("split", F.explode("labels").alias("x")).groupBy("split", "x.code").agg(F.sum("x.n").alias("n")).collect():
            have[splits.index(r.split), r.code] = r.n

        def score(batches, have=have):
            for b in batches:
                lists = b.column(2)
                flat = lists.flatten()
                of = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(lists.offsets)))
                own = np.array([splits.index(x) for x in b.column(1).to_pylist()], "i8")
                g = _gains(flat.field("code").to_numpy(), flat.field("n").to_numpy().astype("f8"), of, b.num_rows, own, have, want).min(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(g)], names=["group", "split", "labels", "gain"])

        tried = now.select("group", "split", "labels").mapInArrow(score, f"group {kind}, split string, labels array<struct<code: int, n: bigint>>, gain double")
        moves = []
        for r in tried.filter("gain < 0").orderBy("gain", "group").limit(at_once).collect():
            code, n = (np.array([x[i] for x in r.labels]) for i in (0, 1))
            g = _gains(code, n.astype("f8"), np.zeros(len(code), "i8"), 1, np.array([splits.index(r.split)]), have, want)[0]
            k = int(g.argmin())
            if g[k] < 0:
                have[splits.index(r.split), code] -= n
                have[k, code] += n
                moves.append((r.group, splits[k]))
        if not moves:
            break
        to = spark.createDataFrame(moves, f"group {kind}, to_ string")
        now = settled(spark, now.join(to, "group", "left").withColumn("split", F.coalesce("to_", "split")).drop("to_"), "assigned")
    return now.select("group", "split", "rows")


def deviation(members: DataFrame, assigned: DataFrame, targets: DataFrame, group: str = "group", label: str = "label") -> DataFrame:
    """Rows (split, wanted, rows, label_deviation): rows of each split beside those wanted, and the share of its rows that would have to bear another label for its labels to be distributed like the whole."""
    lab = F.coalesce(F.col(label).cast("string"), F.lit(""))
    m = members.select(F.col(group).alias("group"), lab.alias("label")).groupBy("group", "label").agg(F.count("*").alias("n"))
    per = m.join(assigned.select("group", "split"), "group").groupBy("split", "label").agg(F.sum("n").alias("n"))  # splits x labels sums
    own, same, every = F.sum("n").over(Window.partitionBy("split")), F.sum("n").over(Window.partitionBy("label")), F.sum("n").over(Window.partitionBy())
    d = per.withColumns({"rows": own, "every": every, "like": same / every})
    # a label that a split lacks is off by its whole share
    d = d.groupBy("split").agg(F.first("rows").alias("rows"), F.first("every").alias("every"), ((F.sum(F.abs(F.col("n") / F.col("rows") - F.col("like"))) + 1 - F.sum("like")) / 2).alias("label_deviation"))
    t = targets.filter("split IS NOT NULL AND share > 0").groupBy("split").agg(F.sum("share").alias("share"))
    t = t.withColumn("share", F.col("share") / F.sum("share").over(Window.partitionBy()))  # one row a split
    whole = F.max("every").over(Window.partitionBy())
    return t.join(d, "split", "left").select("split", (F.col("share") * F.coalesce(whole, F.lit(0))).alias("wanted"), F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), "label_deviation")


def split_records(records: DataFrame, targets: DataFrame, id_col: str = "fid", label: str = "label") -> DataFrame:
    """Rows (id, group, split, label) of all records: records on the same ground in one split, records without ground one by one."""
    groups = settled(records.sparkSession, record_groups(records, id_col), "groups")
    every = records.select(F.col(id_col).alias("id"), F.col(label).alias("label")).filter("id IS NOT NULL").groupBy("id").agg(F.min("label").alias("label"))
    # Group ids are footprint hashes; a record without ground gets a hash of its own kind.
    member = every.join(groups, "id", "left").withColumn("group", F.coalesce("group", F.xxhash64(F.lit("alone"), "id")))
    member = settled(records.sparkSession, member, "grouped")
    return member.join(assign_splits(member, targets).select("group", "split"), "group").select("id", "group", "split", "label")
