"""Record predicates as columns; all of them reach the Parquet scan, nested fields included."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BBox = tuple[float, float, float, float]


def name(c: str) -> Column:
    """A top-level column by its exact name, colons and dots included."""
    return F.col("`" + c.replace("`", "``") + "`")


def check_bbox(box: Sequence[float], strict: bool = False) -> BBox:
    if len(box) != 4:
        raise ValueError("a bbox has four values: xmin, ymin, xmax, ymax")
    x0, y0, x1, y1 = map(float, box)
    if x0 > x1 or y0 > y1 or (strict and (x0 >= x1 or y0 >= y1)):
        raise ValueError(f"bbox is inverted{' or empty' if strict else ''}: {tuple(box)}")
    return x0, y0, x1, y1


def cloud_below(limit: float, column: str = "eo:cloud_cover") -> Column:
    """Strictly below; null never passes. The limit must lie in 0 to 100."""
    if not 0 <= limit <= 100:
        raise ValueError("cloud cover limit must lie in 0 to 100")
    return name(column) < float(limit)


def moment(text: str) -> datetime:
    """A date means its midnight."""
    return datetime.fromisoformat(text.replace("Z", ""))


def _ntz(t: datetime) -> Column:
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def date_between(start: str | None, end: str | None, column: str = "datetime", kind: str = "timestamp_ntz", partitions: Sequence[str] = ()) -> Column:
    """Inclusive at both ends; an end date means its midnight. Integer columns hold years, and only years are compared.

    ``partitions`` may name ``year`` and ``month`` columns derived from the column: their bounds are added, so
    that partitions are pruned.
    """
    lo, hi = (moment(x) if x else None for x in (start, end))
    if lo and hi and lo > hi:
        raise ValueError(f"date range is inverted: {start} > {end}")
    if lo is None and hi is None:
        raise ValueError("a date range needs a start or an end")
    out = []
    if kind in ("int", "bigint", "smallint"):
        out += [name(column) >= lo.year] if lo else []
        out += [name(column) <= hi.year] if hi else []
    else:
        out += [name(column) >= _ntz(lo)] if lo else []
        out += [name(column) <= _ntz(hi)] if hi else []
        if "year" in partitions:
            out += [F.col("year") >= lo.year] if lo else []
            out += [F.col("year") <= hi.year] if hi else []
            if "month" in partitions and lo and hi and lo.year == hi.year:
                out += [F.col("month").between(lo.month, hi.month)]
    return reduce(lambda a, b: a & b, out)


def bbox_overlaps(box: Sequence[float], column: str = "bbox") -> Column:
    """Touching counts."""
    x0, y0, x1, y1 = check_bbox(box)
    c = name(column)
    return (c["xmax"] >= x0) & (c["xmin"] <= x1) & (c["ymax"] >= y0) & (c["ymin"] <= y1)


def bbox_shares_area(box: Sequence[float], column: str = "bbox") -> Column:
    """Touching doesn't count."""
    x0, y0, x1, y1 = check_bbox(box)
    c = name(column)
    return (F.least(c["xmax"], F.lit(x1)) > F.greatest(c["xmin"], F.lit(x0))) & (F.least(c["ymax"], F.lit(y1)) > F.greatest(c["ymin"], F.lit(y0)))


def any_bbox(boxes: Sequence[Sequence[float]], column: str = "bbox") -> Column:
    """Overlaps one of a few boxes, for boxes given by the caller."""
    if not boxes:
        raise ValueError("no geometries given")
    return reduce(lambda a, b: a | b, (bbox_overlaps(b, column) for b in boxes))


def split_in(split: str | Sequence[str], column: str = "split") -> Column:
    if isinstance(split, str):
        return name(column) == split
    values = list(split)
    if not values or not all(isinstance(v, str) for v in values):
        raise ValueError("split must be a text or a non-empty sequence of texts")
    return name(column).isin(values)


_OPS = {"==": lambda c, v: c == v, ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, "<": lambda c, v: c < v, "in": lambda c, v: c.isin(list(v))}


def clause(path: str, op: str, value) -> Column:
    if op not in _OPS:
        raise ValueError(f"unknown operator {op!r}")
    top, *inner = path.split(".")
    return _OPS[op](reduce(lambda c, p: c[p], inner, name(top)), value)


def dnf(filters: list[list[tuple[str, str, object]]]) -> Column:
    """An OR of ANDs of (column, operator, value)."""
    if not filters or not all(filters):
        raise ValueError("an empty disjunction")
    return reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (clause(*c) for c in conj)) for conj in filters))


def dnf_and(a: list[list], b: list[list]) -> list[list]:
    """Both: the cross product of the disjuncts."""
    return [[*x, *y] for x in a for y in b] if a and b else a or b
