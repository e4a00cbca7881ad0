"""Mixing sources to target weights (problem 9).

Sizes are tokens. Each source's token stream is cut into blocks of fixed length; every output shard draws how
many of its slots each source gets from a multinomial; a source's slots, numbered across the shards, go through
a pseudorandom permutation of its blocks, one permutation per pass, and are joined to the blocks by index. So no
block, and no document, is used more often than there are passes.

Defined cases
  * A document belongs to a target whatever case and outer blanks; documents of other or no sources count for the
    total but are not drawn. Null and empty texts have no tokens.
  * A weight that is null, NaN or negative is 0; ``max_repeats`` null or below 0 is 0. Targets that differ only in
    case or blanks are one, with the sum of weights and the larger cap.
  * A source is out of reach if its share of the total exceeds ``max_repeats`` times its own tokens (so a source
    with a weight but without tokens is). It then gives all it may, and the others share the rest by weight.
    ``out_of_reach`` draws the mix at the target's own shares, and holds the sources whose slots stayed empty, or
    nearly so (the draw is random), against the exact figures.
  * Of all slots a capped source draws beyond its cap stay empty; the report counts what came out.
  * With no weights or no tokens the mix is empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenegrain.llm.tokens import encode
from scenegrain.session import settled


def _name(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def sized(docs: DataFrame, vocabulary_file: str | None = None) -> DataFrame:
    """Rows (doc_id, key, tokens): ``key`` is the source in small letters without outer blanks."""
    d = docs.select("doc_id", _name(F.col("source")).alias("key"), "text")
    return encode(d, vocabulary_file=vocabulary_file, column="tokens", only_count=True)


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: source, wanted (share), tokens, cap (max_repeats x tokens), out_of_reach, total (tokens of all documents)."""
    w = F.col("weight").cast("double")
    t = targets.filter("source IS NOT NULL").select("source", _name(F.col("source")).alias("key"), F.when((w > 0) & ~F.isnan(w), w).otherwise(0.0).alias("weight"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))
    t = t.groupBy("key").agg(F.min("source").alias("source"), F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    # One row a source, read for the sums and for the join; the texts are encoded once.
    have = settled(sizes.sparkSession, sizes.groupBy("key").agg(F.sum("tokens").alias("tokens")), "tokens")
    total = have.agg(F.sum("tokens")).first()[0] or 0
    weights = t.agg(F.sum("weight")).first()[0] or 0.0
    j = t.join(have, "key", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0).cast("long"))).withColumn("total", F.lit(total).cast("long"))
    j = j.withColumn("wanted", F.col("weight") / weights if weights > 0 else F.lit(0.0)).withColumn("cap", F.col("max_repeats") * F.col("tokens"))
    return j.select("source", "key", "wanted", "max_repeats", "tokens", "cap", "total", (F.col("wanted") * F.col("total") > F.col("cap")).alias("out_of_reach"))


def reachable_shares(rows: list[dict], total: float) -> dict[str, float]:
    """Shares that caps allow: sources above their cap are set to it, the others scale up by weight, until none is above."""
    fixed: dict[str, float] = {}
    while True:
        open_ = {r["key"]: r["wanted"] for r in rows if r["key"] not in fixed and r["wanted"] > 0}
        room, weight = 1 - sum(fixed.values()), sum(open_.values())
        shares = {k: room * w / weight for k, w in open_.items()} if weight > 0 else {}
        above = [r for r in rows if r["key"] in shares and shares[r["key"]] * total > r["cap"]]
        if not above:
            return fixed | shares
        fixed |= {r["key"]: r["cap"] / total for r in above}


def permute(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of 0 .. n - 1 at ``index``: a Feistel network over the next power of four, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    x = index.astype("u8")
    todo = np.ones(len(x), bool)
    while todo.any():
        l, r = x[todo] >> np.uint64(half), x[todo] & mask
        for k in range(4):
            with np.errstate(over="ignore"):
                h = (r + np.uint64((seed * 4 + k) % (1 << 62))) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
                h *= np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(32)
            l, r = r, l ^ (h & mask)
        x[todo] = (l << np.uint64(half)) | r
        todo[todo] = x[todo] >= n
    return x.astype("i8")


def blocks(sizes: DataFrame, block: int, buckets: int = 4096) -> DataFrame:
    """Rows (key, block, doc_id, start, length): the pieces of documents that fill each block of each source's token stream.

    Positions are prefix sums in order of a hash; sums per source and bucket come first, so a source of a third
    of all rows is spread over ``buckets`` windows.
    """
    d = sizes.filter("key IS NOT NULL AND tokens > 0").withColumn("h", F.xxhash64("doc_id")).withColumn("b", F.pmod("h", F.lit(buckets)))
    sums = d.groupBy("key", "b").agg(F.sum("tokens").alias("n"))
    before = sums.select("key", "b", (F.sum("n").over(Window.partitionBy("key").orderBy("b")) - F.col("n")).alias("before"))
    inner = F.sum("tokens").over(Window.partitionBy("key", "b").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    at = d.withColumn("inner", inner).join(before, ["key", "b"]).withColumn("at", F.col("before") + F.col("inner"))
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("tokens") - 1) / block)
    p = at.withColumn("block", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("at"), F.col("block") * block)
    hi = F.least(F.col("at") + F.col("tokens"), (F.col("block") + 1) * block)
    return p.select("key", "block", "doc_id", (lo - F.col("at")).alias("start"), (hi - lo).alias("length"))


def _drawn(docs: DataFrame, targets: DataFrame, block: int, slots_per_shard: int, size: int | None, seed: int, vocabulary_file: str | None, limited: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix, one row per source with what was drawn and what came out, and the blocks; ``limited``: at the shares that the caps allow, else at the target's own."""
    spark = docs.sparkSession
    sizes = settled(spark, sized(docs, vocabulary_file), "sizes")
    rows = [r.asDict() for r in plan(sizes, targets).orderBy("key").collect()]  # one row per target source
    total = float(size or (rows[0]["total"] if rows else 0))
    shares = (reachable_shares(rows, total) if total else {}) if limited else {r["key"]: r["wanted"] for r in rows}
    slots = int(total // block)
    shards = -(-slots // slots_per_shard)
    keys = [r["key"] for r in rows if shares.get(r["key"], 0) > 0 and (r["tokens"] > 0 or not limited)]
    prob = np.array([shares[k] for k in keys])
    spare = max(0.0, 1 - float(prob.sum()))
    full = {r["key"]: -(-r["tokens"] // block) for r in rows}
    repeats = {r["key"]: r["max_repeats"] for r in rows}

    def draw(shard: int) -> np.ndarray:
        n = min(slots_per_shard, slots - shard * slots_per_shard)
        p = np.append(prob, spare)
        return np.random.default_rng([seed, shard]).multinomial(n, p / p.sum())[: len(keys)]

    def counts(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            drawn = [draw(i) for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, len(keys)).astype("i8")), pa.array(keys * len(ids), pa.string()), pa.array(np.concatenate(drawn).astype("i8") if drawn else np.empty(0, "i8"))], names=["shard", "key", "n"])

    per = spark.range(shards).mapInArrow(counts, "shard long, key string, n long").withColumn("part", F.floor(F.col("shard") / 1024))
    # slots are numbered through a source's shards: sums per 1,024 shards first, so that no task numbers them all
    parts = per.groupBy("key", "part").agg(F.sum("n").alias("m"))
    parts = parts.select("key", "part", (F.sum("m").over(Window.partitionBy("key").orderBy("part")) - F.col("m")).alias("before"))
    inner = F.sum("n").over(Window.partitionBy("key", "part").orderBy("shard")) - F.col("n")
    per = per.withColumn("inner", inner).join(parts, ["key", "part"]).select("shard", "key", "n", (F.col("before") + F.col("inner")).alias("first"))

    def number(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for shard, key, n, first in zip(*(b.column(i).to_pylist() for i in range(4))):
                at = np.arange(first, first + n)
                at = at[at < full[key] * repeats[key]]
                for k in np.unique(at // max(full[key], 1)):
                    own = at[at // full[key] == k]
                    out[0].append(np.full(len(own), shard)), out[1].append(np.full(len(own), keys.index(key)))
                    out[2].append(own), out[3].append(np.full(len(own), k)), out[4].append(permute(own % full[key], full[key], seed * 1_000_003 + keys.index(key) * 8191 + int(k)))
            cols = [np.concatenate(c).astype("i8") if c else np.empty(0, "i8") for c in out]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array([keys[i] for i in cols[1]], pa.string()), *map(pa.array, cols[2:])], names=["shard", "key", "slot", "pass", "block"])

    placed = per.mapInArrow(number, "shard long, key string, slot long, `pass` long, block long")
    named = spark.createDataFrame([(r["key"], r["source"]) for r in rows], "key string, source string")
    out = placed.join(blocks(sizes, block), ["key", "block"]).join(named, "key").select("shard", "slot", "source", "pass", "block", "doc_id", "start", "length")
    slim = [(r["key"], r["source"], r["wanted"], float(shares.get(r["key"], 0.0)), r["tokens"], r["out_of_reach"], r["max_repeats"], slots) for r in rows]
    target = spark.createDataFrame(slim, "key string, source string, wanted double, reachable double, tokens long, out_of_reach boolean, max_repeats int, all_slots long")
    given = out.groupBy("source").agg(F.sum("length").alias("tokens_out"), F.count_distinct("slot").alias("filled"))
    drawn = per.groupBy("key").agg(F.sum("n").alias("slots"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    report = target.join(given, "source", "left").join(drawn, "key", "left").select(*target.columns, zero("tokens_out"), zero("filled"), zero("slots"))
    return out, report, sizes


def mix(docs: DataFrame, targets: DataFrame, block: int = 512, slots_per_shard: int = 4096, size: int | None = None, seed: int = 11, vocabulary_file: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix (shard, slot, source, pass, block, doc_id, start, length) and its report (source, wanted, reachable, actual, tokens, tokens_out, slots, filled, out_of_reach).

    ``size``: tokens to give out, by default as many as all documents have.
    """
    out, report, _ = _drawn(docs, targets, block, slots_per_shard, size, seed, vocabulary_file, True)
    every = F.sum("tokens_out").over(Window.partitionBy())  # one row a source
    report = report.withColumn("actual", F.when(every > 0, F.col("tokens_out") / every).otherwise(0.0))
    return out, report.select("source", "wanted", "reachable", "actual", "tokens", "tokens_out", "slots", "filled", "out_of_reach")


def out_of_reach(docs: DataFrame, targets: DataFrame, block: int = 512, slots_per_shard: int = 4096, seed: int = 11, vocabulary_file: str | None = None) -> DataFrame:
    """The sources whose target share can't be reached within their cap: those that leave drawn slots empty in a mix at the target's shares.

    A source that came within six standard deviations of the draw, and the last block of each pass, of leaving slots
    empty is a candidate too; candidates are then held against the exact tokens.
    """
    _, report, _ = _drawn(docs, targets, block, slots_per_shard, None, seed, vocabulary_file, False)
    noise = 6 * F.sqrt(F.col("all_slots") * F.col("wanted") * (1 - F.least("wanted", F.lit(1.0)))) + F.col("max_repeats") + 2
    room = F.ceil(F.col("tokens") / block) * F.col("max_repeats")
    empty = F.col("slots") > F.col("filled")
    return report.filter((empty | (F.col("filled") + noise >= room)) & F.col("out_of_reach")).select("source")
