"""Column-level data quality profile per load (problem 4).

``value_counts`` pre-aggregates each column to (load, value, rows); all else works on these counts, so a
load that holds a third of all rows is spread by value and never one task's. Regular expressions of text
columns come from ``induce_expressions`` by minimum description length over all distinct values. Rows that don't conform
are counted by expression: one whose texts all match the column's pattern, or none of whose do, decides for all values under
it, and only values under the others are checked one by one. ``coverage_changes`` compares expressions between loads.

Defined cases
  * All rows count as they are, repeated rows too; NaN counts as null. Rows without a load form the load null.
  * Shares of an empty set are null and raise no issue; an empty table has an empty profile.
  * Medians are exact; of an even number of values the mean of the two in the middle.
  * A value outside its rule counts as out of range or nonconforming, but stays in the other figures.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenegrain.operators.joins import salted_join
from scenegrain.session import settled


@dataclass(frozen=True)
class ColumnRule:
    """What holds for a column: ``valid`` is a SQL condition on the row (range), ``pattern`` a regular expression for the whole text.

    ``numeric`` columns get a median over their valid values and its change between loads, within ``bounds``.
    """

    column: str
    valid: str | None = None
    pattern: str | None = None
    bounds: tuple[float, float] | None = None


@dataclass(frozen=True)
class Limits:
    """How far a load may differ before it is reported."""

    null_share: float = 0.15
    outside_share: float = 0.06
    pattern_share: float = 0.06
    median_shift: float = 15.0
    constant_share: float = 0.5


def _quoted(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def value_counts(df: DataFrame, rule: ColumnRule, load: str) -> DataFrame:
    """Rows (load, v, ok, n): how many of a load's rows hold value ``v``, by whether they are valid; NaN is null."""
    c = F.col(_quoted(rule.column))
    kind = dict(df.dtypes)[rule.column]
    v = F.when(~F.isnan(c), c) if kind in ("double", "float") else c
    ok = F.coalesce(F.expr(rule.valid), F.lit(True)) if rule.valid else F.lit(True)
    return df.select(F.col(_quoted(load)).alias("load"), v.alias("v"), ok.alias("ok")).groupBy("load", "v", "ok").agg(F.count("*").alias("n"))


# One token is a run of capitals, of small letters, of digits or of blanks, or any other single character.
_TOKEN = r"(\p{Lu}+|\p{Ll}+|[0-9]+|\s+|[^\p{Lu}\p{Ll}0-9\s])"
_CLASSES = (("[0-9]", math.log2(10)), (r"\p{Lu}", math.log2(26)), (r"\p{Ll}", math.log2(26)), (r"\s", 1.0))
#: Bits of the model for a class with a length, and for the second end of a span of lengths.
_MODEL_BITS, _LENGTH_BITS = 10.0, 8.0


def induce_expressions(values: DataFrame, value: str = "v") -> DataFrame:
    """Rows (v, expression, bits): for each distinct text the expression it falls under and the bits it costs.

    A text is a sequence of tokens, and texts with the same kinds of tokens in the same order have one shape. At each place of a
    shape the two-part code ``L(model) + L(data | model)`` over all distinct values is made small: a token stands literally (its
    letters once in the model; each value pays to name it among the others), or under its class with its length
    (class and length once in the model, each value pays for the letters), or all lengths of the class under one span
    (both ends in the model, each value pays for its length too). The sums split over places, so only counts
    per (shape, place, text) are needed. A null has no expression.
    """
    d = values.filter(F.col(value).isNotNull()).select(F.col(value).cast("string").alias("v")).distinct()
    d = d.withColumn("tokens", F.regexp_extract_all("v", F.lit(_TOKEN), 1))
    cls = lambda t: F.when(t.rlike("^[0-9]"), 0).when(t.rlike(r"^\p{Lu}"), 1).when(t.rlike(r"^\p{Ll}"), 2).when(t.rlike(r"^\s"), 3).otherwise(4)
    d = d.withColumn("shape", F.concat_ws(",", F.transform("tokens", lambda t: F.when(cls(t) < 4, cls(t).cast("string")).otherwise(F.concat(F.lit("="), t)))))
    long = settled(values.sparkSession, d.select("v", "shape", F.posexplode_outer("tokens").alias("pos", "token")).withColumn("pos", F.coalesce("pos", F.lit(-1))).withColumn("token", F.coalesce("token", F.lit(""))), "tokens")
    place = ["shape", "pos"]
    per = long.groupBy(*place, "token").agg(F.count("*").alias("n"))
    whole = per.groupBy(*place).agg(F.sum("n").alias("all"))
    per = per.join(whole, place).withColumns({"size": F.length("token"), "cls": F.when(F.col("token") == "", 4).otherwise(cls(F.col("token")))})
    letter = F.element_at(F.array(*[F.lit(b) for _, b in _CLASSES], F.lit(8.0)), F.col("cls") + 1)
    named = F.col("n") * F.log2(F.col("all") / F.col("n"))  # to tell the token from the others at its place
    per = per.withColumns({"literal": 8.0 * F.col("size") + 2 + named, "classed": F.col("n") * F.col("size") * letter})
    # of a class and length: worth its own model if what it saves on the tokens that it would stand for pays for it
    by_size = per.groupBy(*place, "cls", "size").agg(F.sum(F.greatest(F.col("literal") - F.col("classed"), F.lit(0.0))).alias("saved"), F.sum(F.when(F.col("classed") < F.col("literal"), F.col("n")).otherwise(0)).alias("stands"), F.first("all").alias("all"))
    by_size = by_size.withColumn("use", (F.col("cls") < 4) & (F.col("saved") > _MODEL_BITS))
    told = F.when(F.col("stands") > 0, F.col("stands") * F.log2(F.col("all") / F.col("stands"))).otherwise(0.0)
    spans = by_size.filter("use").groupBy(*place).agg(F.count("*").alias("sizes"), F.min("size").alias("lo"), F.max("size").alias("hi"), F.sum(told + _MODEL_BITS).alias("apart"), F.sum("stands").alias("stand"))
    joint = _MODEL_BITS + _LENGTH_BITS + F.col("stand") * F.log2(F.col("hi") - F.col("lo") + 1)
    spans = spans.withColumn("span", (F.col("sizes") > 1) & (joint < F.col("apart"))).select(*place, "lo", "hi", "span")
    per = per.join(by_size.select(*place, "size", "use"), [*place, "size"]).join(spans, place, "left")
    text = F.element_at(F.array(*[F.lit(c) for c, _ in _CLASSES], F.lit("")), F.col("cls") + 1)
    escaped = F.regexp_replace("token", r"([\\.^$|?*+()\[\]{}/-])", r"\\$1")
    span = F.coalesce("span", F.lit(False))
    free = F.col("use") & (F.col("classed") < F.col("literal"))
    length = F.when(span, F.concat(F.lit("{"), F.col("lo").cast("string"), F.lit(","), F.col("hi").cast("string"), F.lit("}"))).otherwise(F.concat(F.lit("{"), F.col("size").cast("string"), F.lit("}")))
    bits = F.when(free, F.col("size") * letter + F.when(span, F.log2(F.col("hi") - F.col("lo") + 1)).otherwise(0.0)).otherwise(F.col("literal") / F.col("n"))
    per = per.select(*place, "token", F.when(free, F.concat(text, length)).otherwise(escaped).alias("part"), bits.alias("bits"))
    # a token such as a common prefix may be nearly every value's: its rows are salted
    j = salted_join(long, per, [*place, "token"]).select("v", "pos", "part", "bits")
    return j.groupBy("v").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x.part), "").alias("expression"), F.sum("bits").alias("bits"))


_ATOM = re.compile(r"(\[[^\]]+\]|\\p\{L[ul]\}|\\s|\\?.)(?:\{(\d+)(?:,(\d+))?\})?", re.DOTALL)


def _atoms(expression: str) -> list[tuple[str, int, int]] | None:
    """(class or letter, least, most) in order, of expressions made of letters, the classes here and counted repeats; None for others."""
    out, at = [], 0
    while at < len(expression):
        m = _ATOM.match(expression, at)
        if m is None or m[1] in "()|*+?.^$" or (m[1][0] == "[" and m[1] != "[0-9]") or (m[1][0] == "\\" and m[1][1].isalnum() and m[1] not in (r"\p{Lu}", r"\p{Ll}", r"\s")):
            return None
        name = m[1] if m[1] in dict(_CLASSES) else m[1][-1]
        lo = int(m[2]) if m[2] else 1
        out.append((name, lo, int(m[3]) if m[3] else lo))
        at = m.end()
    return out


def _holds(name: str, other: str) -> bool | None:
    """Whether all (True) or none (False) of the letters of one atom are of another; None: some."""
    if name == other:
        return True
    known = dict(_CLASSES)
    if name in known:
        return False if other in known or not _is(other, name) else None
    return _is(name, other) if other in known else False


def _is(letter: str, name: str) -> bool:
    return {"[0-9]": letter in "0123456789", r"\p{Lu}": letter.isupper(), r"\p{Ll}": letter.islower(), r"\s": letter in " \t\n\r\f\v"}[name]


def conformity(expression: str, pattern: str, most: int = 4096) -> str:
    """Whether ``all``, ``none`` or ``some`` of the texts of an induced expression match a pattern; ``some`` also where that can't be told.

    Both are written out letter by letter for each length they allow (at most ``most`` in all, else ``some``).
    """

    def written(atoms) -> list[list[str]] | None:
        out: list[list[str]] = [[]]
        for name, lo, hi in atoms:
            out = [w + [name] * k for w in out for k in range(lo, hi + 1)]
            if len(out) > 64 or sum(map(len, out)) > most:
                return None
        return out

    parts = [_atoms(x) for x in (expression, pattern)]
    words = [None if p is None else written(p) for p in parts]
    if None in words:
        return "some"
    said = []
    for w in words[0]:
        hits = [[_holds(a, b) for a, b in zip(w, p)] for p in words[1] if len(p) == len(w)]
        said.append("all" if any(all(x is True for x in h) for h in hits) else "none" if all(any(x is False for x in h) for h in hits) else "some")
    return said[0] if len(set(said)) == 1 else "some"


def judged(induced: DataFrame, pattern: str) -> DataFrame:
    """Adds ``fits``, whether the value matches the pattern: by its expression, and by itself where its expression doesn't decide."""
    kinds = induced.select("expression").distinct()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([conformity(x, pattern) for x in b.column(0).to_pylist()], pa.string())], names=["expression", "conforms"])

    told = kinds.mapInArrow(run, "expression string, conforms string")
    exact = F.col("v").rlike(f"^(?:{pattern})\\z") & ~F.col("v").contains("\n")
    j = salted_join(induced, told, ["expression"])
    return j.withColumn("fits", F.when(F.col("conforms") == "some", exact).otherwise(F.col("conforms") == "all")).drop("conforms")


def exact_median(counts: DataFrame, bounds: tuple[float, float], buckets: int = 256) -> DataFrame:
    """Exact median per load of (load, v, n) within bounds: a histogram finds the bucket, then only that bucket is sorted."""
    lo, hi = bounds
    c = counts.filter(F.col("v").between(lo, hi)).groupBy("load", "v").agg(F.sum("n").alias("n"))
    c = c.withColumn("b", F.floor((F.col("v") - lo) / ((hi - lo) / buckets)))
    hist = c.groupBy("load", "b").agg(F.sum("n").alias("nb"))
    w = Window.partitionBy("load")
    hist = hist.withColumn("before", F.sum("nb").over(w.orderBy("b")) - F.col("nb")).withColumn("total", F.sum("nb").over(w))
    half = [F.floor((F.col("total") - 1) / 2), F.ceil((F.col("total") - 1) / 2)]
    holds = lambda r, start, n: (start <= r) & (r < start + n)
    hist = hist.filter(holds(half[0], F.col("before"), F.col("nb")) | holds(half[1], F.col("before"), F.col("nb")))
    hist = hist.select(F.col("load").alias("load_"), F.col("b").alias("b_"), "before", "total")
    j = c.join(hist, F.col("load").eqNullSafe(F.col("load_")) & (F.col("b") == F.col("b_")))
    j = j.withColumn("at", F.col("before") + F.sum("n").over(Window.partitionBy("load", "b").orderBy("v")) - F.col("n"))
    low, high = (F.max(F.when(holds(h, F.col("at"), F.col("n")), F.col("v"))) for h in half)
    return j.groupBy("load").agg(((low + high) / 2).alias("median"))


def profile(df: DataFrame, rules: list[ColumnRule], load: str = "load_id") -> DataFrame:
    """One row per load and column: rows, nulls, distinct values, smallest and largest value, rows out of range, rows that don't conform,
    the most frequent value's rows, the median, and for texts the leading induced expression with its coverage of the load."""
    out = []
    for r in rules:
        vc = value_counts(df, r, load)
        if r.pattern or r.bounds:  # read several times
            vc = settled(df.sparkSession, vc, "counts")
        n, has = F.col("n"), F.col("v").isNotNull()
        text = r.pattern is not None
        if text:
            ind = settled(df.sparkSession, judged(induce_expressions(vc), r.pattern), "expressions")
            vc = vc.join(ind.select(F.col("v").alias("v2"), "expression", "fits"), F.col("v") == F.col("v2"), "left").drop("v2")
        else:
            vc = vc.withColumn("expression", F.lit(None).cast("string")).withColumn("fits", F.lit(True))
        top = F.max(F.when(has, F.col("n_value"))).alias("top_rows")
        per_value = vc.groupBy("load", "v", "expression", "fits").agg(F.sum("n").alias("n_value"), F.sum(F.when(~F.col("ok"), n).otherwise(0)).alias("n_out"))
        stats = per_value.groupBy("load").agg(
            F.sum("n_value").alias("rows"),
            F.sum(F.when(~has, F.col("n_value")).otherwise(0)).alias("nulls"),
            F.count(F.when(has, 1)).alias("distinct"),
            F.min("v").cast("string").alias("smallest"),
            F.max("v").cast("string").alias("largest"),
            F.sum(F.when(has, F.col("n_out")).otherwise(0)).alias("outside"),
            F.sum(F.when(has & ~F.col("fits"), F.col("n_value")).otherwise(0)).alias("nonconforming"),
            top,
        )
        if text:
            cover = per_value.filter(has).groupBy("load", "expression").agg(F.sum("n_value").alias("c")).groupBy("load").agg(F.max(F.struct(F.col("c"), F.col("expression"))).alias("e"))
            cover = cover.select(F.col("load").alias("l2"), F.col("e.expression").alias("expression"), F.col("e.c").alias("covered"))
            stats = stats.join(cover, F.col("load").eqNullSafe(F.col("l2")), "left").drop("l2")
        else:
            stats = stats.withColumn("expression", F.lit(None).cast("string")).withColumn("covered", F.lit(None).cast("long"))
        if r.bounds:
            med = exact_median(vc.select("load", "v", "n"), r.bounds).withColumnRenamed("load", "l3")
            stats = stats.join(med, F.col("load").eqNullSafe(F.col("l3")), "left").drop("l3")
        else:
            stats = stats.withColumn("median", F.lit(None).cast("double"))
        filled = F.col("rows") - F.col("nulls")
        share = lambda x, of: F.when(of > 0, x / of)
        out.append(stats.select(
            F.col("load").alias(load), F.lit(r.column).alias("column_name"), "rows", "nulls", share(F.col("nulls"), F.col("rows")).alias("null_share"), "distinct", "smallest", "largest",
            share(F.col("outside"), filled).alias("outside_share"), share(F.col("nonconforming"), filled).alias("nonconforming_share"), share(F.col("top_rows"), filled).alias("top_share"),
            "expression", share(F.col("covered"), filled).alias("expression_coverage"), "median",
        ))
    table = out[0]
    for t in out[1:]:
        table = table.unionByName(t)
    return table


def issues(prof: DataFrame, load: str = "load_id", limits: Limits = Limits()) -> DataFrame:
    """Rows (load, column_name, issue): the loads that break away from the others or break the rules of the column."""
    usual = prof.groupBy("column_name").agg(F.median("null_share").alias("usual_nulls"), F.median("median").alias("usual_median"))
    j = prof.join(usual, "column_name")
    found: list[tuple[str, Column]] = [
        ("nulls", F.abs(F.col("null_share") - F.col("usual_nulls")) > limits.null_share),
        ("range", F.col("outside_share") > limits.outside_share),
        ("pattern", F.col("nonconforming_share") > limits.pattern_share),
        ("shift", F.abs(F.col("median") - F.col("usual_median")) > limits.median_shift),
        ("constant", F.col("top_share") > limits.constant_share),
    ]
    return j.select(load, "column_name", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in found]))).alias("issue"))


#: The rules of the three profiled columns of a record collection.
RECORD_RULES = [
    ColumnRule("eo:cloud_cover", valid="`eo:cloud_cover` BETWEEN 0 AND 100", bounds=(0.0, 100.0)),
    ColumnRule("datetime", valid="datetime >= TIMESTAMP_NTZ '1984-01-01 00:00:00' AND (ingested_at IS NULL OR datetime <= ingested_at)"),
    ColumnRule("crs", pattern="EPSG:[0-9]{4,5}"),
]


def coverage(df: DataFrame, rule: ColumnRule, load: str = "load_id") -> DataFrame:
    """Rows (load, column_name, expression, conforms, rows, coverage): how many of a load's non-null values fall under each induced expression, and how many of these match the rule."""
    vc = settled(df.sparkSession, value_counts(df, rule, load).filter("v IS NOT NULL"), "counts")
    ind = judged(induce_expressions(vc), rule.pattern).select(F.col("v").alias("v2"), "expression", "fits")
    per = vc.join(ind, F.col("v") == F.col("v2")).groupBy("load", "expression").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("fits"), F.col("n")).otherwise(0)).alias("conforms"))
    every = vc.groupBy("load").agg(F.sum("n").alias("all_")).withColumnRenamed("load", "l2")
    j = per.join(every, F.col("load").eqNullSafe(F.col("l2")))
    return j.select(F.col("load").alias(load), F.lit(rule.column).alias("column_name"), "expression", "conforms", "rows", (F.col("rows") / F.col("all_")).alias("coverage"))


def coverage_changes(cover: DataFrame, load: str = "load_id") -> DataFrame:
    """Rows (load, column_name, expression, coverage, usual, change): each expression's coverage of a load beside the median of its coverage of all loads; 0 where a load lacks it.

    An expression that is new to the loads, or that most loads have and one lacks, shows as a change of its whole coverage.
    """
    loads = cover.select(load, "column_name").distinct()
    n = loads.groupBy("column_name").agg(F.count("*").alias("loads_"))
    # the median over all loads, where those without the expression count 0: from the sorted shares of those that have it
    have = cover.groupBy("column_name", "expression").agg(F.sort_array(F.collect_list("coverage")).alias("c_")).join(n, "column_name")  # one number a load
    c = F.concat(F.array_repeat(F.lit(0.0), (F.col("loads_") - F.size("c_")).cast("int")), F.col("c_"))
    mid = lambda k: F.element_at(F.col("all_"), k)
    half = F.floor(F.col("loads_") / 2).cast("int")
    usual = have.withColumn("all_", c).select("column_name", "expression", F.when(F.col("loads_") % 2 == 1, mid(half + 1)).otherwise((mid(half) + mid(half + 1)) / 2).alias("usual"))
    lacking = loads.join(usual.filter("usual > 0"), "column_name").join(cover.select(load, "column_name", "expression"), [load, "column_name", "expression"], "left_anti")
    both = cover.join(usual, ["column_name", "expression"]).select(load, "column_name", "expression", "coverage", "usual")
    both = both.unionByName(lacking.select(load, "column_name", "expression", F.lit(0.0).alias("coverage"), "usual"))
    return both.withColumn("change", F.col("coverage") - F.col("usual"))
