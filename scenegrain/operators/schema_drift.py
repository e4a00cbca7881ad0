"""Schemas that drift between files (problem 1).

Each file's readable JSON lines are flattened to (path, kind, value) for a set
of target fields. A file's *fingerprint* is the sorted list of the path and
kind under which it carries each field; files of a stream in time order get a
version number that rises whenever the fingerprint differs from that of the
file before. ``migrations`` gives each file its version, with the chain of
rename, default and cast rules that leads from the version to the one table,
and the chain of the version before. ``changes`` reports every step between
two versions; ``unify`` routes each line through the chain of its file's version.

Defined cases
  * A line that is no JSON object, or is cut off or null, is unreadable: it comes out of ``unify``
    with ``readable = false`` and null fields, and counts for no fingerprint.
  * A key with a null value carries the field but has no kind.
  * Repeats of a line (equal ``file_id``, ``line_no`` and fields) count once.
  * Ties between paths or kinds go to the smaller text.
  * A file without ``stream`` or ``written_at`` has a fingerprint but no place in an order: no changes.
  * Files of one stream and one time follow each other by ``file_id``.
  * Values that a cast rule cannot convert become null and are named in ``cast_failed``.
  * A line that carries a field under another path or in another kind than its version is named in ``deviates`` and
    mapped by a rule of its own. Lines of files without a version go by the file's own fingerprint.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A target field: its name, SQL type, the normalised last key segments that mean it, and words for numbers."""

    name: str
    type: str
    keys: tuple[str, ...]
    words: tuple[tuple[str, int], ...] = ()


# TIFF tag numbers, the names under which writers spell the fields, and TIFF's photometric codes.
HEADER_FIELDS = (
    Field("nodata", "double", ("nodata", "gdalnodata", "nodatavalue", "42113")),
    Field("samples_per_pixel", "int", ("samplesperpixel", "spp", "277")),
    Field(
        "photometric",
        "int",
        ("photometric", "photometricinterpretation", "262"),
        (("miniswhite", 0), ("minisblack", 1), ("rgb", 2), ("palette", 3), ("mask", 4), ("cmyk", 5), ("separated", 5), ("ycbcr", 6), ("cielab", 8)),
    ),
    Field("extra_samples", "array<int>", ("extrasamples", "338")),
)


def _kind(v) -> str | None:
    if v is None:
        return None
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    if isinstance(v, str):
        return "string"
    return "array" if isinstance(v, list) else "object"


def _hits(o: dict, wanted: dict[str, int], n: int) -> list:
    """For each target field the (path, value) in the object, shallow and small paths first."""
    out: list = [None] * n
    level = [((), o)]
    while level:
        below = []
        for path, node in level:
            for k, v in node.items():
                at = (*path, k)
                f = wanted.get("".join(c for c in k.lower() if c.isalnum()))
                if f is not None and (out[f] is None or (len(out[f][0]), out[f][0]) > (len(at), at)):
                    out[f] = (at, v)
                elif isinstance(v, dict):
                    below.append((at, v))
                elif isinstance(v, list):
                    below += [(at, x) for x in v if isinstance(x, dict)]
        level = below
    return out


def flatten(lines: DataFrame, fields: tuple[Field, ...] = HEADER_FIELDS, payload: str = "payload") -> DataFrame:
    """One row per line: the keys of the line, ``readable`` and for each field ``{name}_path``, ``_kind``, ``_text``.

    JSON of any nesting is outside what a fixed Spark schema can express, hence one Arrow-batched pass.
    """
    keep = [c for c in ("file_id", "stream", "written_at", "received_at", "line_no") if c in lines.columns]
    wanted = {k: i for i, f in enumerate(fields) for k in f.keys}
    parts = [f"{f.name}_{x}" for f in fields for x in ("path", "kind", "text")]
    src = lines.select(*keep, payload)
    schema = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in src.schema if x.name != payload), "readable boolean", *(f"`{p}` string" for p in parts)])

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in parts]
            ok = []
            for text in b.column(payload).to_pylist():
                try:
                    o = json.loads(text) if text else None
                except (ValueError, RecursionError):
                    o = None
                ok.append(isinstance(o, dict))
                hits = _hits(o, wanted, len(fields)) if ok[-1] else [None] * len(fields)
                for i, h in enumerate(hits):
                    path, v = h or (None, None)
                    cols[3 * i].append(h and ".".join(path))
                    cols[3 * i + 1].append(_kind(v))
                    cols[3 * i + 2].append(None if v is None else v if isinstance(v, str) else json.dumps(v))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(ok, pa.bool_()), *(pa.array(c, pa.string()) for c in cols)], names=[*keep, "readable", *parts])

    return src.mapInArrow(run, schema)


def fingerprints(flat: DataFrame, fields: tuple[Field, ...] = HEADER_FIELDS) -> DataFrame:
    """One row per file: stream, written_at and for each field ``{name}_path`` and ``{name}_kind`` (null: not carried), ``fingerprint``."""
    marks = [F.col(f"{f.name}_{x}") for f in fields for x in ("path", "kind")]
    once = flat.filter("file_id IS NOT NULL").select("file_id", "stream", "written_at", "line_no", "readable", *marks).distinct()
    long = once.select(
        "file_id", "stream", "written_at",
        F.explode(F.array(*[F.struct(F.lit(f.name).alias("field"), F.col(f"{f.name}_path").alias("path"), F.col(f"{f.name}_kind").alias("kind")) for f in fields])).alias("e"),
    ).select("file_id", "stream", "written_at", "e.*")
    counted = long.groupBy("file_id", "field", "path", "kind").agg(F.count("*").alias("n"), F.max("stream").alias("stream"), F.max("written_at").alias("written_at"))

    def most(value: Column, n: str) -> Column:  # most frequent, ties to the smaller text
        return F.min(F.when(value.isNotNull(), F.struct((-F.col(n)).alias("n"), value.alias("v"))))["v"]

    by_path = counted.withColumn("n_path", F.when(F.col("path").isNotNull(), F.sum("n").over(Window.partitionBy("file_id", "field", "path"))))
    by_kind = by_path.withColumn("n_kind", F.when(F.col("kind").isNotNull(), F.sum("n").over(Window.partitionBy("file_id", "field", "kind"))))
    per = by_kind.groupBy("file_id", "field").agg(most(F.col("path"), "n_path").alias("path"), most(F.col("kind"), "n_kind").alias("kind"), F.max("stream").alias("stream"), F.max("written_at").alias("written_at"))
    at = lambda f, x: F.max(F.when(F.col("field") == f.name, F.col(x))).alias(f"{f.name}_{x}")
    wide = per.groupBy("file_id").agg(F.max("stream").alias("stream"), F.max("written_at").alias("written_at"), *[at(f, x) for f in fields for x in ("path", "kind")])
    return wide.withColumn("fingerprint", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(f"{f.name}_{x}"), F.lit("~")) for f in fields for x in ("path", "kind")]), 256))


def _previous(files: DataFrame, cols: list[str]) -> DataFrame:
    """``prev_{c}`` of the file before in the stream, null for the first.

    A stream may hold a third of all files, so no task gets a whole stream: inside a (stream, month) a
    plain ``lag`` serves, and the first file of a month takes the last of the month before from a summary
    with one row per stream and month.
    """
    order = [F.col("written_at"), F.col("file_id")]
    f = files.filter("stream IS NOT NULL AND written_at IS NOT NULL").withColumn("month_", F.date_trunc("month", "written_at"))
    row = F.struct("written_at", "file_id", *cols)
    inner = f.withColumn("p_", F.lag(row).over(Window.partitionBy("stream", "month_").orderBy(*order)))
    last = f.groupBy("stream", "month_").agg(F.max_by(row, F.struct("written_at", "file_id")).alias("last_"))
    carried = last.withColumn("before_", F.lag("last_").over(Window.partitionBy("stream").orderBy("month_"))).drop("last_")
    j = inner.join(carried, ["stream", "month_"], "left").withColumn("p_", F.coalesce("p_", "before_"))
    return j.select(*files.columns, F.col("p_").isNull().alias("first_"), *[F.col(f"p_.{c}").alias(f"prev_{c}") for c in cols])


def migrations(prints: DataFrame, fields: tuple[Field, ...] = HEADER_FIELDS) -> DataFrame:
    """One row per file: its ``version`` in its stream (null without a place in one), whether it ``starts`` the version, the fingerprint, the
    version's ``rules`` and those of the version ``before`` (null for the first).

    A field's rules: ``rename`` from the path that carries it (null: already under its name, or not carried), ``default`` for a
    field that isn't carried, ``cast`` from the kind. The version counts the changes of the fingerprint along the stream; it
    comes from the counts per month, so again no task holds a whole stream.
    """
    rule = lambda f: F.struct(
        F.lit(f.name).alias("field"),
        F.when(F.col(f"{f.name}_path") != f.name, F.col(f"{f.name}_path")).alias("rename"),
        F.when(F.col(f"{f.name}_path").isNull(), F.lit("null")).alias("default"),
        F.col(f"{f.name}_kind").alias("cast"),
    )
    ruled = prints.select("file_id", "stream", "written_at", "fingerprint", F.array(*[rule(f) for f in fields]).alias("rules"))
    j = _previous(ruled, ["fingerprint", "rules"])
    j = j.withColumn("step_", F.when(F.col("first_") | (F.col("fingerprint") != F.col("prev_fingerprint")), 1).otherwise(0)).withColumn("month_", F.date_trunc("month", "written_at"))
    month = j.groupBy("stream", "month_").agg(F.sum("step_").alias("n_"))
    base = month.withColumn("base_", F.coalesce(F.sum("n_").over(Window.partitionBy("stream").orderBy("month_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n_")
    inner = F.sum("step_").over(Window.partitionBy("stream", "month_").orderBy("written_at", "file_id"))
    v = j.withColumn("inner_", inner).join(base, ["stream", "month_"], "left")
    ordered = v.select("file_id", "stream", "written_at", (F.col("base_") + F.col("inner_")).cast("int").alias("version"), (F.col("step_") == 1).alias("starts"), "fingerprint", "rules", F.col("prev_rules").alias("before"))
    return ordered.unionByName(ruled.filter("stream IS NULL OR written_at IS NULL"), allowMissingColumns=True)


def changes(migrated: DataFrame, fields: tuple[Field, ...] = HEADER_FIELDS) -> DataFrame:
    """Rows (file_id, stream, field, change, was, now): the fields added, removed, renamed or retyped by each step from one version to the next."""
    steps = migrated.filter("starts AND before IS NOT NULL")
    out = []
    for i, f in enumerate(fields):
        now, old = F.col("rules")[i], F.col("before")[i]
        path, p0 = (F.when(r["default"].isNull(), F.coalesce(r["rename"], F.lit(f.name))) for r in (now, old))
        for change, when, was, is_ in (
            ("added", old["default"].isNotNull() & now["default"].isNull(), p0, path),
            ("removed", old["default"].isNull() & now["default"].isNotNull(), p0, path),
            ("renamed", path != p0, p0, path),
            ("retyped", path.isNotNull() & p0.isNotNull() & (now["cast"] != old["cast"]), old["cast"], now["cast"]),
        ):
            out.append(F.when(when, F.struct(F.lit(f.name).alias("field"), F.lit(change).alias("change"), was.alias("was"), is_.alias("now"))))
    return steps.select("file_id", "stream", F.explode(F.array_compact(F.array(*out))).alias("c")).select("file_id", "stream", "c.*")


def _cast(f: Field, kind: Column) -> Column:
    """The cast rule of a field from a kind, on the text of the value."""
    text = F.trim(F.col(f"{f.name}_text"))
    number = text.try_cast("double")
    if f.type.startswith("array"):
        inner = F.regexp_replace(text, r"[\[\]\s\"]", "")
        parts = F.filter(F.split(inner, ","), lambda x: x != "")
        listed = F.transform(parts, lambda x: x.try_cast("double").cast("int"))
        return F.when(kind == "number", F.array(number.cast("int"))).when(text.isNotNull(), listed)
    word = F.lower(F.regexp_replace(text, "[^A-Za-z]", ""))
    named = F.lit(None).cast("int")
    for w, n in f.words:
        named = F.when(word == w, F.lit(n)).otherwise(named)
    spelt = F.coalesce(number, named.cast("double")) if f.words else number
    return F.when(kind == "string", spelt).otherwise(number).cast(f.type)


def unify(flat: DataFrame, migrated: DataFrame, fields: tuple[Field, ...] = HEADER_FIELDS) -> DataFrame:
    """All lines in one table with one column and type per field, each mapped by the rules of its file's version.

    ``version``; ``renamed_from``, ``deviates`` and ``cast_failed`` record what was done to the line.
    """
    keep = [c for c in ("file_id", "stream", "written_at", "received_at", "line_no", "readable") if c in flat.columns]
    rules = migrated.select(F.col("file_id").alias("file_"), "version", "rules")
    j = flat.join(rules, F.col("file_id") == F.col("file_"), "left")
    vals, failed, moved, odd = [], [], [], []
    for i, f in enumerate(fields):
        r = F.col("rules")[i]
        path, kind, text = (F.col(f"{f.name}_{x}") for x in ("path", "kind", "text"))
        ruled = F.when(r["default"].isNull(), F.coalesce(r["rename"], F.lit(f.name)))
        same = path.eqNullSafe(ruled) & (kind.isNull() | (kind == r["cast"]))
        # the chain of the version where the line keeps to it, else the line's own rename and cast
        value = _cast(f, F.when(F.coalesce(same, F.lit(False)), r["cast"]).otherwise(kind))
        vals.append(value.alias(f.name))
        lost = F.exists(value, lambda x: x.isNull()) if f.type.startswith("array") else F.lit(False)
        failed.append(F.when(text.isNotNull() & (value.isNull() | lost), F.lit(f.name)))
        moved.append(F.when(path != f.name, F.when(F.coalesce(same, F.lit(False)), r["rename"]).otherwise(path)))
        odd.append(F.when(F.col("readable") & F.col("rules").isNotNull() & ~F.coalesce(same, F.lit(False)), F.lit(f.name)))
    lists = [F.array_compact(F.array(*x)).alias(n) for x, n in ((moved, "renamed_from"), (odd, "deviates"), (failed, "cast_failed"))]
    return j.select(*keep, "version", *vals, *lists)
