import pytest

from weirstone.operators.timestamps import normalise_times, times_found

SITES = [("cn", "Asia/Shanghai", "ymd"), ("de", "Europe/Berlin", "dmy"), ("us", "America/Chicago", "mdy"), ("odd", "No/Zone", None)]
CASES = [
    ("cn", "2024-01-05", "2024-01-05", "normal"), ("cn", " 2024-01-05 ", "2024-01-05", "day"), ("cn", "2024年1月5日", "2024-01-05", "day"), ("cn", "２０２４年１月５日", "2024-01-05", "day"),
    ("cn", "20240105", "2024-01-05", "day"), ("cn", "2019-02-30", None, "unreadable"), ("cn", "2024-05", None, "unreadable"), ("cn", "近日", None, "unreadable"), ("cn", "", None, "unreadable"), ("cn", None, None, "null"),
    ("de", "05/06/2024", "2024-06-05", "day"), ("us", "05/06/2024", "2024-05-06", "day"), ("us", "25/06/2024", None, "unreadable"), ("odd", "25/06/2024", "2024-06-25", "day"), ("odd", "05/06/2024", None, "unreadable"),
    ("cn", "2024-01-05 08:00", "2024-01-05T00:00:00.000000Z", "instant"), ("cn", "2024年1月5日 下午12:10", "2024-01-05T04:10:00.000000Z", "instant"), ("cn", "2024年1月5日 上午12:10", "2024-01-04T16:10:00.000000Z", "instant"),
    ("us", "Nov 3, 2024 1:30 AM", "2024-11-03T06:30:00.000000Z", "ambiguous"), ("us", "2024-03-10 02:30:00", "2024-03-10T08:30:00.000000Z", "nonexistent"), ("us", "Sun Nov 03 01:30:00 CST 2024", "2024-11-03T07:30:00.000000Z", "instant"),
    ("cn", "Fri Jan 05 08:00:00 CST 2024", "2024-01-05T00:00:00.000000Z", "instant"), ("de", "Wed, 20 Mar 2019 06:14:06 +0800", "2019-03-19T22:14:06.000000Z", "instant"), ("de", "2018-06-22 09:18:51.511562-03:30", "2018-06-22T12:48:51.511562Z", "instant"),
    ("cn", "1516306284.0", "2018-01-18T20:11:24.000000Z", "instant"), ("cn", "1562587900611", "2019-07-08T12:11:40.611000Z", "instant"), ("cn", "1417460218999423", "2014-12-01T18:56:58.999423Z", "instant"), ("cn", "20120325030444", "2012-03-24T19:04:44.000000Z", "instant"),
    ("none", "2024-01-05 08:00", "2024-01-05T08:00:00.000000Z", "instant"), ("cn", "2024-01-05T08:00:00.000000Z", "2024-01-05T08:00:00.000000Z", "normal"), ("cn", "x" * 50000, None, "unreadable"), ("cn", "2024-13-01 25:00", None, "unreadable"),
]


def tables(spark, rows):
    kb = spark.createDataFrame([(i, s, v, v, 1) for i, (s, v, _, _) in enumerate(rows)], "seq long, source string, date string, added_at string, tz int")
    return kb, spark.createDataFrame(SITES, "name string, tz string, date_order string")


def test_cases(spark):
    kb, sites = tables(spark, CASES + CASES[:3])
    got = {(r.seq, r.field): (r.norm, r.status) for r in normalise_times(kb, sites, ["date", "added_at"], "seq").collect()}
    assert len(got) == 2 * (len(CASES) + 3)
    for i, (source, value, norm, status) in enumerate(CASES):
        assert got[i, "date"] == (norm, status), (source, value)
        assert got[i, "added_at"] == got[i, "date"]


def test_found_leaves_normal_values_out(spark):
    kb, sites = tables(spark, CASES)
    assert {r.seq for r in times_found(kb, sites).collect()} == {i for i, c in enumerate(CASES) if c[3] not in ("null", "normal", "unreadable")}


def test_empty(spark):
    kb, sites = tables(spark, CASES)
    assert times_found(kb.limit(0), sites).count() == 0
    assert times_found(kb, sites.limit(0)).count() > 0


def test_every_zone_agrees_with_python(spark):
    from datetime import datetime
    from zoneinfo import ZoneInfo

    zones = ["Asia/Kolkata", "Australia/Sydney", "America/St_Johns", "Europe/London"]
    sites = spark.createDataFrame([(z, z, "ymd") for z in zones], "name string, tz string, date_order string")
    times = [datetime(y, m, 15, 13, 7, 9) for y in (1975, 2001, 2024, 2040) for m in (1, 4, 7, 11)]
    rows = [(i, z, t.strftime("%Y-%m-%d %H:%M:%S"), None) for i, (z, t) in enumerate((z, t) for z in zones for t in times)]
    kb = spark.createDataFrame(rows, "seq long, source string, date string, added_at string")
    got = {r.seq: r.norm for r in times_found(kb, sites).collect()}
    for i, z, t, _ in rows:
        assert got[i] == datetime.fromisoformat(t).replace(tzinfo=ZoneInfo(z)).astimezone(ZoneInfo("UTC")).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


if __name__ == "__main__":
    pytest.main([__file__])
