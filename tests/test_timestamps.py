import zoneinfo
from datetime import datetime, timedelta, timezone

import pytest

from scenegrain.operators import timestamps as T

FEEDS = [("b", "Europe/Berlin", "dmy"), ("n", "America/New_York", "mdy"), ("lh", "Australia/Lord_Howe", "dmy"), ("u", "UTC", "ymd"), ("x", None, "ymd"), ("odd", "Mars/Base", "dmy")]


def us(*a, zone=None, fold=0, micro=0):
    t = datetime(*a, micro, tzinfo=zoneinfo.ZoneInfo(zone) if zone else timezone.utc, fold=fold)
    return (t - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


CASES = [
    ("b", "2020-05-01T12:00:00Z", us(2020, 5, 1, 12, 0, 0)), ("b", " 2020-05-01t12:00:00z ", us(2020, 5, 1, 12, 0, 0)), ("b", "2020-05-01 12:00", us(2020, 5, 1, 12, 0, 0, zone="Europe/Berlin")),
    ("b", "2020-05-01T12:00:00.123456789Z", us(2020, 5, 1, 12, 0, 0, micro=123456)), ("b", "2020-05-01T12:00:00,5", us(2020, 5, 1, 12, 0, 0, zone="Europe/Berlin", micro=500000)),
    ("b", "01/05/2020 3:04:05 PM", us(2020, 5, 1, 15, 4, 5, zone="Europe/Berlin")), ("n", "05/01/2020 12:04:05 AM", us(2020, 5, 1, 0, 4, 5, zone="America/New_York")), ("n", "13/01/2020 01:00", "impossible"),
    ("b", "2020-05-01", us(2020, 5, 1, 0, 0, 0, zone="Europe/Berlin")), ("b", "2020", us(2020, 1, 1, 0, 0, 0, zone="Europe/Berlin")), ("b", "20200501T120000", us(2020, 5, 1, 12, 0, 0, zone="Europe/Berlin")),
    ("b", "20200501120000", us(2020, 5, 1, 12, 0, 0, zone="Europe/Berlin")), ("b", "20200501_120000", us(2020, 5, 1, 12, 0, 0, zone="Europe/Berlin")), ("b", "1588334400", us(2020, 5, 1, 12, 0, 0)), ("b", "1588334400.25", us(2020, 5, 1, 12, 0, 0, micro=250000)),
    ("b", "1588334400123", us(2020, 5, 1, 12, 0, 0, micro=123000)), ("b", "1588334400123456", us(2020, 5, 1, 12, 0, 0, micro=123456)), ("b", "2020-122T12:00:00Z", us(2020, 5, 1, 12, 0, 0)), ("b", "2019-366T00:00:00Z", "impossible"),
    ("b", "Fri, 01 May 2020 12:00:00 GMT", us(2020, 5, 1, 12, 0, 0)), ("b", "Fri, 01 May 2020 12:00:00 -0230", us(2020, 5, 1, 14, 30, 0)), ("b", "1 May 2020 12:00:00", us(2020, 5, 1, 12, 0, 0, zone="Europe/Berlin")),
    ("b", "May 1, 2020 12:00:00", us(2020, 5, 1, 12, 0, 0, zone="Europe/Berlin")), ("b", "01-MAY-2020 12:00:00", us(2020, 5, 1, 12, 0, 0, zone="Europe/Berlin")), ("b", "2020-05-01T12:00:00+05:45", us(2020, 5, 1, 6, 15, 0)),
    ("b", "2020-05-01 12:00:00 −03:30", us(2020, 5, 1, 15, 30, 0)), ("b", "2020-05-01 12:00:00-05", us(2020, 5, 1, 17, 0, 0)), ("b", "2020-05-01 12:00:00[America/New_York]", us(2020, 5, 1, 16, 0, 0)),
    ("u", "2020-05-01 12:00:00 asia/kolkata", us(2020, 5, 1, 6, 30, 0)), ("b", "2020-05-01 12:00:00 Mars/Base", "unknown zone"), ("b", "2020-05-01 12:00:00 CEST", us(2020, 5, 1, 10, 0, 0)), ("b", "2020-05-01 12:00:00 EST", "unknown zone"),
    ("b", "2020-10-25 02:30:00", "twice"), ("b", "2020-10-25 02:30:00 CET", us(2020, 10, 25, 1, 30, 0)), ("b", "2020-10-25 02:30:00 CEST", us(2020, 10, 25, 0, 30, 0)), ("b", "2020-03-29 02:30:00", "skipped"), ("b", "2020-10-25 03:00:00", us(2020, 10, 25, 2, 0, 0)),
    ("lh", "2020-04-05 01:45:00", "twice"), ("lh", "2020-04-05 01:15:00", us(2020, 4, 4, 14, 15, 0)), ("lh", "2020-10-04 02:15:00", "skipped"), ("n", "2020-03-08 02:30", "skipped"), ("n", "2020-11-01 01:30", "twice"),
    ("b", "2020-05-01T24:00:00Z", us(2020, 5, 2, 0, 0, 0)), ("b", "2020-05-01T25:61:00Z", "impossible"), ("b", "2020-02-30 10:00:00", "impossible"), ("b", "0000-00-00 00:00:00", "impossible"), ("b", "2020-13-01T00:00:00Z", "impossible"),
    ("b", None, "unusable"), ("b", "", "unusable"), ("b", "n/a", "unusable"), ("b", "--", "unusable"), ("b", "12:00", "unusable"), ("b", "x" * 100_000, "unusable"), ("x", "2020-05-01 12:00", "unknown zone"), ("x", "2020-05-01T12:00Z", us(2020, 5, 1, 12, 0, 0)),
    ("odd", "2020-05-01 12:00", "unknown zone"), (None, "2020-05-01 12:00", "unknown zone"), (None, "1588334400", us(2020, 5, 1, 12, 0, 0)), ("u", "01/05/2020 10:00", "unusable"),
]


def feeds(spark):
    return spark.createDataFrame(FEEDS, "feed string, zone string, date_order string")


def test_notations(spark):
    rows = [(i, f, t, None, "clash", "clash", 7) for i, (f, t, _) in enumerate(CASES)]
    items = spark.createDataFrame(rows, "item_no long, feed string, datetime string, received_at timestamp_ntz, zone_name string, status string, feed_ int")
    got = {r.item_no: r for r in T.normalise(items, feeds(spark)).collect()}
    assert len(got) == len(CASES)
    wrong = [(CASES[i], got[i].status, got[i].utc_us) for i, (_, _, want) in enumerate(CASES) if (got[i].utc_us if isinstance(want, int) else got[i].status) != want or (isinstance(want, str) and got[i].utc_us is not None)]
    assert not wrong
    assert got[0].zone_name == "clash" and got[0].feed_ == 7


def test_random_local_times_agree_with_zoneinfo(spark):
    import random

    rng, rows, want = random.Random(1), [], {}
    for i in range(1500):
        f, zone, _ = rng.choice([x for x in FEEDS[:3]])
        z = zoneinfo.ZoneInfo(zone)
        t = datetime(2018, 1, 1) + timedelta(minutes=rng.randrange(3 * 365 * 24 * 60))
        a, b = (t.replace(tzinfo=z, fold=k).astimezone(timezone.utc) for k in (0, 1))
        ok = [x for x in {a, b} if x.astimezone(z).replace(tzinfo=None) == t]
        want[i] = (ok[0] - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1) if len(ok) == 1 else None
        rows.append((i, f, t.strftime("%Y-%m-%d %H:%M"), None))
    items = spark.createDataFrame(rows, "item_no long, feed string, datetime string, received_at timestamp_ntz")
    assert {r.item_no: r.utc_us for r in T.normalise(items, feeds(spark)).collect()} == want


def test_estimated_zone(spark):
    rows, k = [], 0
    for day in range(60):
        for hour in range(0, 24, 3):
            u = datetime(2021, 5, 1) + timedelta(days=day, hours=hour)
            late = u + timedelta(minutes=10 + (k * 7) % 170)
            rows.append((k, "x", u.strftime("%Y-%m-%dT%H:%M:%SZ") if k % 2 else (u + timedelta(hours=5, minutes=30)).strftime("%Y-%m-%d %H:%M:%S"), late))
            k += 1
    items = spark.createDataFrame(rows, "item_no long, feed string, datetime string, received_at timestamp_ntz")
    e = T.with_estimates(T.normalise(items, feeds(spark))).filter("status = 'unknown zone'").selectExpr("(p_.local_us - estimated_us) / 60000000 as off").distinct().collect()
    assert [r.off for r in e] == [pytest.approx(330, abs=15)]


def test_estimated_zone_with_late_arrivals_and_changes_of_offset(spark):
    import random

    rng, rows, want, zone = random.Random(3), [], {}, zoneinfo.ZoneInfo("America/Chicago")
    for k in range(2400):
        u = datetime(2020, 1, 1, tzinfo=timezone.utc) + timedelta(minutes=rng.randrange(2 * 365 * 24 * 60))
        delay = timedelta(hours=rng.uniform(60, 6000)) if rng.random() < 0.11 else timedelta(hours=rng.uniform(0.5, 24))
        local, text = u.astimezone(zone).replace(tzinfo=None), k % 3 == 0
        if not text:
            want[k] = us(*u.timetuple()[:6])
        # feed "y" has no row whose text gives the instant
        rows.append((k, "x" if text or k % 3 == 1 else "y", u.strftime("%Y-%m-%dT%H:%M:%SZ") if text else local.strftime("%Y-%m-%d %H:%M:%S"), (u + delay).replace(tzinfo=None)))
    items = spark.createDataFrame(rows, "item_no long, feed string, datetime string, received_at timestamp_ntz")
    both = spark.createDataFrame([("x", None, "ymd"), ("y", None, "ymd")], "feed string, zone string, date_order string")
    got = {r.item_no: r.estimated_us for r in T.with_estimates(T.normalise(items, both)).filter("status = 'unknown zone'").collect()}
    assert set(got) == set(want)
    for feed in (1, 2):
        mine = [k for k in want if k % 3 == feed]
        assert sum(got[k] == want[k] for k in mine) > 0.95 * len(mine)


def test_empty(spark):
    items = spark.createDataFrame([], "item_no long, feed string, datetime string, received_at timestamp_ntz")
    assert T.with_estimates(T.normalise(items, feeds(spark))).count() == 0
    one = spark.createDataFrame([(1, "b", "2020-05-01 12:00", None)], "item_no long, feed string, datetime string, received_at timestamp_ntz")
    assert T.normalise(one, feeds(spark).limit(0)).first().status == "unknown zone"
