"""Mixed timestamp formats and time zones to one instant in UTC (problem 5).

Texts are read in one Arrow-batched kernel: one regular expression parts a text from its zone, one parts date from
time, one reads the date, and the zone's rules give the instant; columns beside the text don't leave the JVM. ``with_estimates`` then gives
local times without a known zone an instant by the likeliest history of offsets of their feed.

Defined cases (``status``)
  * ``ok``: exactly one instant. ``utc_us`` is set only here, in microseconds, further digits cut off.
  * ``unusable``: null, empty or no notation that is known. ``impossible``: a date or time that doesn't exist.
  * ``unknown zone``: local time of a feed without zone, or with a zone name or abbreviation that isn't known.
    Such rows also get ``estimated_us`` where ``estimate_zones`` can tell.
  * ``skipped`` / ``twice``: local time that the zone left out, or had twice while the text doesn't tell which.
  * 24:00:00 is the first moment of the next day; other hours beyond 23 are impossible.
  * An offset beyond 18 hours is impossible. A month's name counts by its first three English letters.
  * ``with_estimates`` tells in ``how`` where an instant comes from; an ``estimated`` one never counts as ``ok``.
  * Items sent again come out as often as they came in; other columns of the input stay beside the result.
"""

from __future__ import annotations

import functools
import zoneinfo
from datetime import date, datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenegrain.session import settled

SECOND = 1_000_000
DAY = 86_400 * SECOND

_SUFFIX = (
    r"^(.*?)(?:(?<=\d|[AaPp][Mm]) ?\[?(Z|z|UTC|GMT|utc|gmt)\]?"
    r"| ?\[([A-Za-z_]+(?:/[A-Za-z0-9_+\-]+)+)\]| ([A-Za-z_]+(?:/[A-Za-z0-9_+\-]+)+)"
    r"|(?<=(?:\d:\d{2}|[Tt_]\d{4}|[Tt_]\d{6})(?:[.,]\d{1,9})? ?)([+\-]\d{2}(?::?\d{2})?)"
    r"|(?<=\d) ((?!AM$|PM$)[A-Z]{2,5}))?$"
)
_CLOCK = r"^(.*?)(?:(?<=\d)[Tt _]+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?: ?([AaPp][Mm]))?)?$"
_DATE = (
    r"^(?:(\d{4})([\-/.])(\d{1,2})\2(\d{1,2})"  # 1, 3, 4: year first
    r"|(\d{1,2})([\-/.])(\d{1,2})\6(\d{4})"  # 5, 7, 8: numeric, year last
    r"|(\d{4})-(\d{3})"  # 9, 10: day of the year
    r"|(\d{1,2})[ \-]([A-Za-z]{3,9})\.?[ \-](\d{4})"  # 11, 12, 13
    r"|([A-Za-z]{3,9})\.? (\d{1,2}),? (\d{4})"  # 14, 15, 16
    r"|(\d{4})(\d{2})(\d{2})(?:(?:[Tt_ ]?(\d{2})(\d{2})(\d{2})|[Tt_ ](\d{2})(\d{2}))(?:[.,](\d+))?)?"  # 17 to 25: digits run together
    r"|(\d{4}))$"  # 26
)
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


_EDGE = regex.compile("^[ \\t\\n\\x0b\\f\\r]+|[ \\t\\n\\x0b\\f\\r]+$|\\x01")
_WEEKDAY = regex.compile(r"^(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*,? +")
_ZONED, _TIMED, _DATED = (regex.compile(x, regex.ASCII) for x in (_SUFFIX, _CLOCK, _DATE))
_BARE = regex.compile(r"^(?:(\d{10})(?:\.(\d+))?|(\d{13})|(\d{16}))$", regex.ASCII)
_NAMES = zoneinfo.available_timezones() - {"localtime", "Factory", "posixrules"}
_BY_KEY = {n.lower(): n for n in sorted(_NAMES)}
_EPOCH = date(1970, 1, 1).toordinal()
_UTC0 = datetime(1970, 1, 1, tzinfo=timezone.utc)
_FIRST, _LAST = (int((datetime(y, m, d, tzinfo=timezone.utc) - _UTC0).total_seconds()) for y, m, d in ((1, 1, 3), (9999, 12, 29)))


@functools.cache
def _zone(key: str) -> zoneinfo.ZoneInfo | None:
    return zoneinfo.ZoneInfo(_BY_KEY[key]) if key in _BY_KEY else None


@functools.cache
def _abbreviations(key: str) -> dict[str, int]:
    """The letter abbreviations of a zone with their offsets in seconds as used since 1970, the latest use of each."""
    z, out = _zone(key), {}
    t = datetime(1970, 1, 15, tzinfo=timezone.utc)
    while t.year < 2038:
        local = t.astimezone(z)
        if (local.tzname() or "").isalpha():
            out[local.tzname()] = int(local.utcoffset().total_seconds())
        t += timedelta(days=61)
    return out


def _offset(z: zoneinfo.ZoneInfo, us: int) -> int:
    """The zone's offset in microseconds at an instant."""
    t = _UTC0 + timedelta(seconds=min(max(us // SECOND, _FIRST), _LAST))
    o = t.astimezone(z).utcoffset()
    return (o.days * 86_400 + o.seconds) * SECOND


def resolve_local(local: int, z: zoneinfo.ZoneInfo, first: bool) -> tuple[int | None, int]:
    """The instant of a local time in a zone, and how many there are (0 skipped, 2 twice).

    The offsets a day before and after bracket any change; each gives a candidate, and the candidates that
    read back as the local time count. With ``first`` the first moment from the local time on is taken.
    """
    a, b = local - _offset(z, local - DAY), local - _offset(z, local + DAY)
    good = [u for u in dict.fromkeys((a, b)) if u + _offset(z, u) == local]
    if first:
        return (min(good) if good else a), 1
    return (good[0] if len(good) == 1 else None), len(good)


def _micros(frac: str | None) -> int:
    return int((frac or "")[:6].ljust(6, "0"))


def read_text(text: str | None, order: str | None) -> dict:
    """What a text says by itself, but for the order of numeric dates: epoch_us or local_us with whole_day, or the fault; utc, name, offset, abbr of its zone."""
    out = {"epoch_us": None, "local_us": None, "whole_day": None, "fault": "unusable", "utc": False, "name": None, "offset": None, "abbr": None}
    if text is None:
        return out
    s = _WEEKDAY.sub("", _EDGE.sub("", text.replace("\u2212", "-").replace("\u2013", "-")))
    if m := _BARE.match(s):
        out["fault"] = None
        out["epoch_us"] = int(m[1]) * SECOND + _micros(m[2]) if m[1] else int(m[3]) * 1000 if m[3] else int(m[4])
        return out
    z = _ZONED.match(s)
    if z is None:
        return out
    out["utc"], out["name"], out["abbr"] = z[2] is not None, (z[3] or z[4] or "").lower() or None, z[6]
    wrong = False
    if z[5]:
        off = z[5].replace(":", "")
        minutes = int(off[3:5] or 0)
        out["offset"] = (-1 if off[0] == "-" else 1) * (int(off[1:3]) * 3600 + minutes * 60)
        wrong = abs(out["offset"]) > 18 * 3600 or minutes > 59
    c = _TIMED.match(z[1].rstrip(" "))
    d = c and _DATED.match(c[1])
    if not d:
        return out
    clocked, digits = c[2] is not None, d[20] is not None or d[23] is not None
    out["whole_day"] = not (clocked or digits)
    named = d[12] or d[14]
    year = d[1] or d[8] or d[9] or d[13] or d[16] or d[17] or d[26]
    if d[8]:
        month, day = (d[7], d[5]) if order == "dmy" else (d[5], d[7]) if order == "mdy" else (None, None)
    elif named:
        key = named[:3].lower()
        month, day = (_MONTHS.index(key) + 1 if key in _MONTHS else 0), d[11] or d[15]
    elif d[26] or d[10]:
        month = day = 1
    else:
        month, day = d[3] or d[18], d[4] or d[19]
    if month is None or (clocked and digits):
        return out
    year, month, day, ordinal = int(year), int(month), int(day), d[10] and int(d[10])
    hour = int(c[2] or d[20] or d[23] or 0)
    if c[6]:
        hour = (hour % 12 + (12 if c[6].lower() == "pm" else 0)) if 1 <= hour <= 12 else 99
    minute, second = int(c[3] or d[21] or d[24] or 0), int(c[4] or d[22] or 0)
    us = _micros(c[5] or d[25])
    leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
    length = (29 if leap else 28) if month == 2 else 30 if month in (4, 6, 9, 11) else 31
    good = year >= 1 and 1 <= month <= 12 and 1 <= day <= length and (ordinal is None or 1 <= ordinal <= 365 + leap)
    midnight = hour == 24 and not (minute or second or us)
    if wrong or not good or not (hour <= 23 or midnight) or minute > 59 or second > 59:
        out["fault"] = "impossible"
        return out
    out["fault"] = None
    out["local_us"] = (date(year, month, day).toordinal() - _EPOCH + (ordinal - 1 if ordinal else 0)) * DAY + (hour * 3600 + minute * 60 + second) * SECOND + us
    return out


def settle(p: dict, feed_zone: str | None) -> tuple[str, int | None, str | None]:
    """(status, utc_us, zone_source) of what a text says, with the zone of its feed."""
    if p["epoch_us"] is not None:
        return "ok", p["epoch_us"], "epoch"
    if p["fault"] is not None:
        return p["fault"], None, None
    key = p["name"] or (feed_zone or "").lower()
    z = _zone(key)
    if p["utc"] or p["offset"] is not None or p["abbr"] is not None:
        offset = 0 if p["utc"] else p["offset"] if p["offset"] is not None else _abbreviations(key).get(p["abbr"]) if z else None
        return ("unknown zone", None, None) if offset is None else ("ok", p["local_us"] - offset * SECOND, "text")
    if z is None:
        return "unknown zone", None, None
    us, n = resolve_local(p["local_us"], z, p["whole_day"])
    return ("ok", us, "text" if p["name"] else "feed") if n == 1 else ("skipped" if n == 0 else "twice", None, None)


_READ = pa.struct([("epoch_us", pa.int64()), ("local_us", pa.int64()), ("whole_day", pa.bool_()), ("fault", pa.string()), ("utc", pa.bool_()), ("name", pa.string()), ("offset", pa.int32()), ("abbr", pa.string())])
_SAID = pa.struct([("p_", _READ), ("status", pa.string()), ("utc_us", pa.int64()), ("zone_source", pa.string())])
_FIELDS = {pa.int64(): T.LongType(), pa.int32(): T.IntegerType(), pa.bool_(): T.BooleanType(), pa.string(): T.StringType()}


def _spark(kind: pa.DataType) -> T.DataType:
    return T.StructType([T.StructField(f.name, _spark(f.type)) for f in kind]) if pa.types.is_struct(kind) else _FIELDS[kind]


@F.arrow_udf(_spark(_SAID))
def said(text: pa.Array, order: pa.Array, zone: pa.Array) -> pa.Array:
    memo: dict = {}  # within a batch; equal texts of a feed mean the same
    rows = []
    for key in zip(text.to_pylist(), order.to_pylist(), zone.to_pylist()):
        r = memo.get(key)
        if r is None:
            p = read_text(key[0], key[1])
            r = memo[key] = {"p_": p} | dict(zip(("status", "utc_us", "zone_source"), settle(p, key[2])))
        rows.append(r)
    return pa.array(rows, _SAID)


#: Delays are told apart in bins up to ``_FAR`` to either side; later (or impossibly early) arrivals are one class of their own.
_FAR = 60 * DAY


def _blocks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and bins of the block that each bin lies in: the likeliest parting of the bins into blocks of even density (dynamic programming), so that edges stay sharp."""
    full = np.nonzero(counts)[0]
    edges = np.unique(np.concatenate([[0], full, full + 1, [len(counts)]]))
    sums = np.concatenate([[0], np.cumsum(counts)])[edges].astype("f8")
    price = 4 - np.log(3.68 * max(sums[-1], 1) ** -0.478)  # a false edge in 20 samples
    best, last = np.zeros(len(edges)), np.zeros(len(edges), int)
    for e in range(1, len(edges)):
        n, w = sums[e] - sums[:e], edges[e] - edges[:e]
        gain = best[:e] + n * np.log(np.maximum(n, 1) / w) - price
        last[e] = gain.argmax()
        best[e] = gain[last[e]]
    rows, wide, e = np.zeros(len(counts)), np.ones(len(counts)), len(edges) - 1
    while e:
        a, b = edges[last[e]], edges[e]
        rows[a:b], wide[a:b] = sums[e] - sums[last[e]], b - a
        e = last[e]
    return rows, wide


def _delay_density(own: np.ndarray, pooled: np.ndarray, pooled_blocks: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Log density over delay bins (the last: far ones): a mixture of the feed's delays, those of all feeds and an even floor.

    The weights are fitted (EM) to the feed's delays, each held against its block without itself; to all feeds' where it has none.
    """
    fit = own if own[:-1].sum() > 1 else pooled
    at, size = np.nonzero(fit[:-1])[0], len(fit) - 1
    parts, held = [np.full(size, 1 / size)], [np.full(len(at), 1 / size)]
    for counts, (rows, wide) in [(pooled, pooled_blocks)] + ([(own, _blocks(own[:-1]))] if fit is own else []):
        total = counts[:-1].sum()
        parts.append(rows / wide / max(total, 1))
        held.append(np.maximum(rows[at] - 1, 0) / wide[at] / max(total - 1, 1))
    p, h, weight = np.array(parts), np.array(held), np.full(len(parts), 1 / len(parts))
    for _ in range(60 if len(at) else 0):
        share = weight[:, None] * h
        weight = (share / share.sum(0) * fit[at]).sum(1) / fit[at].sum()
        weight[0] = max(weight[0], 0.01)
        weight /= weight.sum()
    # Far delays have the density of the floor, so that no offset gains by pushing a row over the border.
    return np.log(np.append(weight @ p, weight[0] / size))


@functools.cache
def _changes(name: str, first: int, last: int) -> tuple[tuple[int, int, int], ...]:
    """(instant, offset before, offset after) of the zone's changes of offset between two instants, all in seconds; the first row holds from the beginning."""
    z = zoneinfo.ZoneInfo(name)
    off = lambda t: int((datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=t)).astimezone(z).utcoffset().total_seconds())
    t, o = first, off(first)
    out = [(first, o, o)]
    while t < last:
        u = t + 14 * 86_400
        p = off(u)
        if p != o:
            a, b = t, u
            while b - a > 1:
                m = (a + b) // 2
                a, b = (m, b) if off(m) == o else (a, m)
            out.append((b, o, off(b)))
            u, p = b, off(b)
        t, o = u, p
    return tuple(out)


def _histories(hours: np.ndarray, ks: np.ndarray, step_s: int) -> np.ndarray:
    """Offsets (index into ``ks``) by hour of local time and history: every distinct one of the zones and every fixed offset. Where a local time is had twice, its first offset."""
    lo, hi = (int(np.clip(h, -600_000, 2_000_000)) * 3600 for h in (hours[0] - 48, hours[-1] + 48))
    found = {}
    for i in range(len(ks)):
        col = np.full(len(hours), i, "u1")
        found[col.tobytes()] = col
    for name in sorted(zoneinfo.available_timezones() - {"localtime", "Factory", "posixrules"}):
        rows = _changes(name, lo, hi)
        starts = np.array([-(2**60), *[t + max(a, b) for t, a, b in rows[1:]]])
        k = np.clip(np.round(np.array([b for _, _, b in rows]) / step_s).astype(int) - ks[0], 0, len(ks) - 1).astype("u1")
        col = k[np.searchsorted(starts, hours * 3600, side="right") - 1]
        found[col.tobytes()] = col
    return np.stack(list(found.values()), axis=1)


def _best_history(hours: np.ndarray, of: np.ndarray, bins: np.ndarray, n: np.ndarray, log_f: np.ndarray, ks: np.ndarray, step_s: int) -> np.ndarray:
    """The offset (in steps) at every hour of the likeliest history: a zone's or a fixed one, or several in turn at a price a change (Viterbi).

    ``of``, ``bins``, ``n``: the hour (ascending index), delay bin of the local text and count of the rows; -1 for rows that say nothing.
    """
    far = len(log_f) - 1
    at = _histories(hours, ks, step_s)
    price = np.log(max(int(n.sum()), 2)) + np.log(at.shape[1])  # where it is, and what it turns to
    cuts = np.searchsorted(of, np.arange(len(hours) + 1))
    stay = np.zeros(at.shape, bool)
    before = np.zeros(len(hours), "i4")
    score = -1e-9 * np.abs(ks)[at[0]].astype("f8")  # ties go to the one nearest to UTC
    for t in range(len(hours)):
        if t:
            before[t] = score.argmax()
            moved = score[before[t]] - price
            stay[t] = score >= moved
            score = np.where(stay[t], score, moved)
        a, b = cuts[t], cuts[t + 1]
        use = np.arange(a, b)[bins[a:b] >= 0]
        if len(use):
            shifted = bins[use][:, None] + ks[None, :]
            shifted = np.where((bins[use][:, None] == far) | (shifted < 0) | (shifted >= far), far, shifted)
            score = score + (n[use][:, None] * log_f[shifted]).sum(0)[at[t]]
    s, out = int(score.argmax()), np.zeros(len(hours), int)
    for t in range(len(hours) - 1, -1, -1):
        out[t] = ks[at[t, s]]
        if t and not stay[t, s]:
            s = int(before[t])
    return out


def estimate_zones(parsed: DataFrame, feed: str, received: str, known_us: Column, unknown: Column, step_minutes: int = 15) -> DataFrame:
    """Rows (feed_, history_: array of (start_us, offset_us) by local time): the offset history of feeds whose zone is unknown, by aligning local times with arrivals.

    Rows whose text gives the instant show how long items take (see ``_delay_density``), rows of other feeds
    where the feed has few or none. A history of offsets gives every row of unknown zone a delay; the likeliest
    one over the feed's whole local time wins. Histories are those of the zones, with their changes of offset,
    fixed offsets, and turns from one to another, each at a price. Whole days and rows without arrival follow, but say nothing.
    Feeds without rows of unknown zone get none, nor does any where no text gives an instant. Only counts per hour of local time and 15-minute bin are compared.
    """
    step_us = step_minutes * 60 * SECOND
    half = _FAR // step_us
    size = 2 * half
    ks = np.arange(-12 * 60 // step_minutes, 14 * 60 // step_minutes + 1)
    arrive = F.unix_micros(F.col(received).cast("timestamp"))

    def bin_of(us: Column) -> Column:
        b = F.floor((arrive - us) / F.lit(step_us)) + half
        return F.when((b >= 0) & (b < size), b).otherwise(F.lit(size)).cast("int")

    timed = ~F.coalesce(F.col("p_.whole_day"), F.lit(False)) & F.col(received).isNotNull()
    known = parsed.filter(known_us.isNotNull() & timed).select(F.col(feed).alias("feed_"), bin_of(known_us).alias("bin_")).groupBy("feed_", "bin_").agg(F.count("*").alias("n_"))
    pooled = np.zeros(size + 1, "i8")  # a fixed number of bins, whatever the rows
    for r in known.groupBy("bin_").agg(F.sum("n_").alias("n_")).collect():
        pooled[r.bin_] = r.n_
    blocks = _blocks(pooled[:-1])
    local = F.col("p_.local_us")
    open_ = parsed.filter(unknown & F.col(feed).isNotNull()).select(F.col(feed).alias("feed_"), F.floor(local / F.lit(3600 * SECOND)).alias("hour_"), F.when(timed, bin_of(local)).otherwise(-1).alias("bin_"))
    open_ = open_.groupBy("feed_", "hour_", "bin_").agg(F.count("*").alias("n_"))
    schema = "feed_ string, history_ array<struct<start_us: bigint, offset_us: bigint>>"

    def solve(u: pa.Table, k: pa.Table) -> pa.Table:
        kinds = pa.schema([("feed_", pa.string()), ("history_", pa.list_(pa.struct([("start_us", pa.int64()), ("offset_us", pa.int64())])))])
        if not u.num_rows or pooled.sum() == 0:
            return kinds.empty_table()
        own = np.zeros(size + 1, "i8")
        if k.num_rows:
            own[k.column("bin_").to_numpy()] = k.column("n_").to_numpy()
        order = np.argsort(u.column("hour_").to_numpy(), kind="stable")
        hour, bins, n = (u.column(c).to_numpy()[order] for c in ("hour_", "bin_", "n_"))
        hours, of = np.unique(hour, return_inverse=True)
        k_ = _best_history(hours, of, bins, n, _delay_density(own, pooled, blocks), ks, step_minutes * 60)
        first = [t for t in range(len(hours)) if t == 0 or k_[t] != k_[t - 1]]
        runs = [{"start_us": int(hours[t]) * 3600 * SECOND, "offset_us": int(k_[t]) * step_us} for t in first]
        return pa.Table.from_pylist([{"feed_": u.column("feed_")[0].as_py(), "history_": runs}], schema=kinds)

    return open_.groupBy("feed_").cogroup(known.groupBy("feed_")).applyInArrow(solve, schema)


#: Columns of the result; columns of the input with these names give way to them.
RESULTS = ("p_", "status", "utc_us", "zone_source")


def normalise(items: DataFrame, feeds: DataFrame, text: str = "datetime", feed: str = "feed") -> DataFrame:
    """The items with ``utc_us``, ``status``, ``zone_source`` (epoch, text, feed) and ``p_``, what was read from the text."""
    # The input travels as one struct, so that none of its names can clash with those used on the way.
    own = [c for c in items.columns if c not in RESULTS]
    slim = items.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row_"), F.col(text).alias("text_"), F.col(feed).alias("item_feed_"))
    f = feeds.select(F.col(feed).alias("feed_"), F.col("zone").alias("feed_zone_"), F.col("date_order").alias("order_")).dropDuplicates(["feed_"])
    j = slim.join(f, F.col("item_feed_") == F.col("feed_"), "left").select("row_", said("text_", "order_", "feed_zone_").alias("said_"))
    return j.select("row_.*", *[F.col(f"said_.{c}").alias(c) for c in RESULTS])


def with_estimates(normal: DataFrame, feed: str = "feed", received: str = "received_at") -> DataFrame:
    """Adds to rows of ``normalise`` whose zone is unknown ``estimated_us``, by the offset history of their feed; and to all ``instant_us``, the one or the other, and ``how``: epoch, text, feed or estimated."""
    normal = settled(normal.sparkSession, normal, "normal")  # read twice: for the histogram and for the rows
    unknown = (F.col("status") == "unknown zone") & F.col("p_.name").isNull() & F.col("p_.abbr").isNull()
    est = estimate_zones(normal, feed, received, F.col("utc_us"), unknown)
    j = normal.join(est, F.col(feed) == F.col("feed_"), "left")
    past = F.filter("history_", lambda h: h["start_us"] <= F.col("p_.local_us"))
    offset = F.element_at(past, -1)["offset_us"]  # each row's own hour is in the history
    j = j.withColumn("estimated_us", F.when(unknown & F.col("history_").isNotNull(), F.col("p_.local_us") - offset)).drop("feed_", "history_")
    how = F.when(F.col("status") == "ok", F.col("zone_source")).when(F.col("estimated_us").isNotNull(), F.lit("estimated"))
    return j.withColumns({"instant_us": F.coalesce("utc_us", "estimated_us"), "how": how})
