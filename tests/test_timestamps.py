import datetime as dt
from zoneinfo import ZoneInfo

import pytest

from tideloom.functions.timestamps import with_instant

CASES = [
    ("20150307070911", "UTC", None, "2015-03-07T07:09:11"),
    ("  2018-03-05T07:09:11Z\t", "Europe/Berlin", None, "2018-03-05T07:09:11"),
    ("2018-03-05 07:09:11.987", "Europe/Berlin", None, "2018-03-05T06:09:11"),
    ("05.03.2018 07:09:11,250", "Europe/Berlin", "DMY", "2018-03-05T06:09:11"),
    ("03/05/2018 7:09 AM", "America/New_York", "MDY", "2018-03-05T12:09:00"),
    ("5/3/18 07:09", "Australia/Sydney", "DMY", "2018-03-04T20:09:00"),
    ("03/05/2018 07:09:11", "UTC", None, None),
    ("13/05/2018 07:09:11", "UTC", None, "2018-05-13T07:09:11"),
    ("1520233751", None, None, "2018-03-05T07:09:11"),
    ("1520233751123456", None, None, "2018-03-05T07:09:11"),
    ("2016-060T00:00:00Z", None, None, "2016-02-29T00:00:00"),
    ("2015-366T00:00:00Z", None, None, None),
    ("Fri, 10 Feb 2017 09:16:28 +0530", "UTC", None, "2017-02-10T03:46:28"),
    ("Apr 22, 2013 10:08:53 CEST", "UTC", None, "2013-04-22T08:08:53"),
    ("Fri Aug  9 19:51:23 2019", "Asia/Kathmandu", None, "2019-08-09T14:06:23"),
    ("00:04, 31 May 2010 (UTC)", "Europe/London", None, "2010-05-31T00:04:00"),
    ("19. März 2023, 15:48 Uhr", "UTC", None, "2023-03-19T15:48:00"),
    ("13 février 2017 12:48", "UTC", None, "2017-02-13T12:48:00"),
    ("2018-03-25 02:30:00", "Europe/Berlin", None, None),  # never
    ("2018-10-28 02:30:00", "Europe/Berlin", None, None),  # twice
    ("2018-10-28 02:30:00 CEST", "Europe/Berlin", None, "2018-10-28T00:30:00"),
    ("2017-02-30 10:00:00", "UTC", None, None), ("2017-02-03 24:00:00", "UTC", None, None), ("2018-06", "UTC", None, None), ("n/a", "UTC", None, None), ("", "UTC", None, None), (None, "UTC", None, None),
    ("2018-06-01 10:00:00", None, None, None), ("2018-06-01 10:00:00", "Mars/Base", None, None), ("x" * 100_000, "UTC", None, None),
]


def run(spark, rows, bare=False):
    df = spark.createDataFrame([(i, *r[:3], "extra") for i, r in enumerate(rows)], "i int, v string, z string, o string, status_ string")
    return {r.i: r.utc_s for r in with_instant(df, "v", "z", "o", bare).collect()}


def test_forms(spark):
    got = run(spark, CASES)
    for i, (v, *_, want) in enumerate(CASES):
        stamp = None if want is None else int(dt.datetime.fromisoformat(want + "+00:00").timestamp())
        assert got[i] == stamp, v


def test_bare_dates_only_where_asked(spark):
    rows = [("2018-06-01", "Asia/Tokyo", None)]
    assert run(spark, rows)[0] is None
    assert run(spark, rows, True)[0] == int(dt.datetime(2018, 5, 31, 15, tzinfo=dt.timezone.utc).timestamp())


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Australia/Lord_Howe", "Asia/Kathmandu"])
def test_every_half_hour_against_zoneinfo(spark, zone):
    z, rows, want = ZoneInfo(zone), [], []
    for day in (dt.datetime(2018, 3, 11), dt.datetime(2018, 3, 25), dt.datetime(2018, 4, 1), dt.datetime(2018, 10, 7), dt.datetime(2018, 10, 28), dt.datetime(2018, 11, 4)):
        for k in range(48):
            t = day + dt.timedelta(minutes=30 * k)
            both = {t.replace(tzinfo=z, fold=f).astimezone(dt.timezone.utc) for f in (0, 1)}
            real = [u for u in both if u.astimezone(z).replace(tzinfo=None) == t]
            rows.append((t.strftime("%Y-%m-%d %H:%M:%S"), zone, None))
            want.append(int(real[0].timestamp()) if len(real) == 1 else None)
    got = run(spark, rows)
    assert [got[i] for i in range(len(rows))] == want


def test_session_zone_does_not_matter(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert run(spark, CASES)[2] == int(dt.datetime(2018, 3, 5, 6, 9, 11, tzinfo=dt.timezone.utc).timestamp())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
