import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
import pytest

from millrace.operators import timestamps as ts
from millrace.operators.zones import zone_table

FEEDS = [
    {"repository": "ny", "zone": "America/New_York", "std_abbrev": "EST", "dst_abbrev": "EDT", "date_order": "MDY"},
    {"repository": "de", "zone": "Europe/Berlin", "std_abbrev": "CET", "dst_abbrev": "CEST", "date_order": "DMY"},
    {"repository": "uk", "zone": "Europe/London", "std_abbrev": "GMT", "dst_abbrev": "BST", "date_order": "DMY"},
    {"repository": "in", "zone": "Asia/Kolkata", "std_abbrev": "IST", "dst_abbrev": None, "date_order": "DMY"},
    {"repository": "jp", "zone": "Asia/Tokyo", "std_abbrev": "JST", "dst_abbrev": None, "date_order": "YMD"},
]


def read(value, repo="ny"):
    return ts.normalise_batch(pd.Series([value], dtype=object), pd.Series([repo], dtype=object), ts.Feeds(FEEDS))[0]


@pytest.mark.parametrize(
    ("value", "repo", "utc"),
    [
        ("2024-04-10T02:39:55Z", "ny", "2024-04-10T02:39:55.000000Z"),
        (" 2024-04-10t02:39:55.1234567z\n", "ny", "2024-04-10T02:39:55.123456Z"),
        ("2024-04-10 02:39", "ny", "2024-04-10T06:39:00.000000Z"),
        ("2024-04-10", "jp", "2024-04-09T15:00:00.000000Z"),
        ("2024-04-10 02:39:55+0530", "ny", "2024-04-09T21:09:55.000000Z"),
        ("2024-04-10 02:39:55 GMT-07:00", "de", "2024-04-10T09:39:55.000000Z"),
        ("2024-04-10T02:39:55+02:00[Europe/Berlin]", "de", "2024-04-10T00:39:55.000000Z"),
        ("04/10/2024 02:39", "ny", "2024-04-10T06:39:00.000000Z"),
        ("04/10/2024 02:39", "de", "2024-10-04T00:39:00.000000Z"),
        ("10.04.2024 02:39:01", "de", "2024-04-10T00:39:01.000000Z"),
        ("2024/04/10 02:39", "jp", "2024-04-09T17:39:00.000000Z"),
        ("10-04-24 02:39", "de", "2024-04-10T00:39:00.000000Z"),
        ("1712716795", "ny", "2024-04-10T02:39:55.000000Z"),
        ("1712716795.250", "ny", "2024-04-10T02:39:55.250000Z"),
        ("1712716795001", "ny", "2024-04-10T02:39:55.001000Z"),
        ("1712716795000001", "ny", "2024-04-10T02:39:55.000001Z"),
        ("2024-W15-3T02:39:55Z", "ny", "2024-04-10T02:39:55.000000Z"),
        ("20240410T023955Z", "ny", "2024-04-10T02:39:55.000000Z"),
        ("20240410T023955", "de", "2024-04-10T00:39:55.000000Z"),
        ("Apr 10, 2024 2:39:55 AM EST", "ny", "2024-04-10T07:39:55.000000Z"),
        ("10/Apr/24 12:39 AM", "ny", "2024-04-10T04:39:00.000000Z"),
        ("Wed, 10 Apr 2024 02:39:55 GMT", "ny", "2024-04-10T02:39:55.000000Z"),
        ("10. März 2024, 02:39 Uhr", "de", "2024-03-10T01:39:00.000000Z"),
        ("April 10, 2024 at 2:39 pm", "in", "2024-04-10T09:09:00.000000Z"),
        ("10 April 2024", "de", "2024-04-09T22:00:00.000000Z"),
        ("2024-01-10 12:00 IST", "in", "2024-01-10T06:30:00.000000Z"),
        ("2024-01-10 12:00 CET", "ny", "2024-01-10T11:00:00.000000Z"),
        ("2024-02-29", "jp", "2024-02-28T15:00:00.000000Z"),
        ("2024-04-10T24:00:00Z", "ny", "2024-04-11T00:00:00.000000Z"),
        # twice: the earlier instant; skipped: the offset before the change
        ("2024-11-03 01:30:00", "ny", "2024-11-03T05:30:00.000000Z"),
        ("2024-03-10 02:30:00", "ny", "2024-03-10T07:30:00.000000Z"),
        ("2024-10-27 02:30", "de", "2024-10-27T00:30:00.000000Z"),
        ("2024-03-31 02:30", "de", "2024-03-31T01:30:00.000000Z"),
        ("2024-04-10 02:39", "unheard", "2024-04-10T02:39:00.000000Z"),
    ],
)
def test_instants(value, repo, utc):
    assert read(value, repo) == utc


@pytest.mark.parametrize("value", [None, "", "  ", "n/a", "null", "2023-02-29", "2023-02-30 10:11:12", "2019-13-04T08:00:00Z", "0000-00-00T00:00:00Z", "31/11/2018 09:15", "2021-0", "2016-06-18T", "25:61", "2021-04-10 25:00", "2021-04-10 10:61", "2021-W60-1", "last Tuesday", "13:00 PM", "2021-04-10 10:00 XYZ", "x" * 100_000, "99999999"])
def test_no_instants(value):
    assert read(value, "de") is None


def test_walls_agree_with_zoneinfo():
    rng = random.Random(1)
    for zone in ("America/New_York", "Europe/London", "Australia/Sydney", "Asia/Kolkata", "America/St_Johns"):
        t, z = zone_table(zone), ZoneInfo(zone)
        for _ in range(400):
            w = datetime(1971, 1, 2) + timedelta(minutes=rng.randrange(60 * 24 * 365 * 80))
            want = int(w.replace(tzinfo=z, fold=0).timestamp())
            assert int(t.to_utc(pd.Series([int(w.replace(tzinfo=timezone.utc).timestamp())]).to_numpy())[0]) == want, (zone, w)


def test_operator(spark):
    rows = [(1, "ny", "2024-04-10 02:39", None, "x", 1), (2, "de", "?", "10.04.2024 02:39:01", "x", 1), (2, "de", "?", "10.04.2024 02:39:01", "x", 1), (3, None, "2024-04-10T02:39:55Z", "", "x", 1)]
    df = spark.createDataFrame(rows, "crawl_seq bigint, repository string, created string, updated string, rec string, utc int").selectExpr("*", "1 AS field")
    feeds = spark.createDataFrame([tuple(f.values()) for f in FEEDS], "repository string, zone string, std_abbrev string, dst_abbrev string, date_order string")
    got = sorted(tuple(r) for r in ts.found_instants({"issues": df}, feeds).collect())
    assert got == [
        ("issues", 1, "created", "2024-04-10T06:39:00.000000Z"),
        ("issues", 2, "updated", "2024-04-10T00:39:01.000000Z"),
        ("issues", 2, "updated", "2024-04-10T00:39:01.000000Z"),
        ("issues", 3, "created", "2024-04-10T02:39:55.000000Z"),
    ]
    assert ts.found_instants({"issues": df.limit(0)}, feeds).count() == 0
    assert ts.found_instants({"issues": df}, feeds.limit(0)).count() == 4  # no feed: UTC, YMD
    assert df.select(ts.parse_column(df.created, df.repository, feeds)).count() == 4


def test_long_values():
    feeds = ts.Feeds([])
    long = "Donnerstag, 23 September 2021 at 10:20:30.123456789012 a.m. uhr GMT-03:00 [America/Argentina/Buenos_Aires]"
    values = [long, "23 September 2021" + " " * 20_000 + "10:20", "23 September 2021" + " " * 20_000 + "!"]
    assert len(long) > 80
    assert ts.normalise_batch(pd.Series(values), pd.Series([None] * 3), feeds).tolist() == ["2021-09-23T13:20:30.123456Z", "2021-09-23T10:20:00.000000Z", None]


def test_feeds_beyond_what_is_sent(spark):
    """Feeds are joined to the rows where they are too many to send: the same result."""
    from millrace.operators import timestamps

    tables = {t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("issues", "comments")}
    feeds = spark.read.parquet("/root/testdata/sf0.001/feeds.parquet")
    few = {tuple(r) for r in timestamps.found_instants(tables, feeds).collect()}
    assert few and {tuple(r) for r in timestamps.found_instants(tables, feeds, sent=0).collect()} == few


def test_results_do_not_depend_on_the_number_of_feeds(spark):
    """Abbreviations are looked up among all feeds, an order counts without a zone, a null repository has no feed."""
    kinds = "repository string, zone string, std_abbrev string, dst_abbrev string, date_order string"
    feeds = [tuple(f.values()) for f in FEEDS] + [
        ("il", "Asia/Jerusalem", "IST", "IDT", "DMY"),  # IST: ambiguous with that of "in"
        ("us", None, None, None, "MDY"),
        ("", "Asia/Tokyo", None, None, "DMY"),
        ("two", "Europe/Berlin", "CET", "CEST", "DMY"),
        ("two", "Europe/Berlin", "CET", "CEST", "DMY"),
        ("two", "America/New_York", "EST", "EDT", "MDY"),
        (None, "Australia/Sydney", "AEST", "AEDT", "DMY"),
    ]
    rows = [
        (1, "ny", "2024-01-10 12:00 CET", "2024-01-10 12:00 IST"),
        (2, "in", "2024-01-10 12:00 IST", "2024-01-10 12:00 EDT"),
        (3, "us", "04/10/2024 02:39", "2024-01-10 12:00 JST"),
        (4, None, "2024-04-10 02:39", "04/10/2024 02:39"),
        (5, "", "2024-04-10 02:39", "04/10/2024 02:39"),
        (6, "two", "2024-01-10 12:00", "04/10/2024 02:39"),
        (7, "unheard", "2024-01-10 12:00 IDT", "2024-01-10 12:00 AEST"),
    ]
    df = spark.createDataFrame(rows, "crawl_seq bigint, repository string, created string, updated string")
    want = {
        (1, "created", "2024-01-10T11:00:00.000000Z"),
        (2, "created", "2024-01-10T06:30:00.000000Z"),
        (2, "updated", "2024-01-10T16:00:00.000000Z"),
        (3, "created", "2024-04-10T02:39:00.000000Z"),
        (3, "updated", "2024-01-10T03:00:00.000000Z"),
        (4, "created", "2024-04-10T02:39:00.000000Z"),
        (4, "updated", "2024-10-04T02:39:00.000000Z"),
        (5, "created", "2024-04-09T17:39:00.000000Z"),
        (5, "updated", "2024-10-03T17:39:00.000000Z"),
        (6, "created", "2024-01-10T11:00:00.000000Z"),
        (6, "updated", "2024-10-04T00:39:00.000000Z"),
        (7, "created", "2024-01-10T09:00:00.000000Z"),
    }
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for order in (feeds, feeds[::-1]):
            for sent in (0, len(feeds)):
                for batch in ("1", "10000"):
                    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
                    got = ts.found_instants({"issues": df}, spark.createDataFrame(order, kinds), sent=sent).collect()
                    assert sorted(tuple(r)[1:] for r in got) == sorted(want), (sent, batch)
            table = ts.load_feeds(spark.createDataFrame(order, kinds))
            got = {(n, f, u) for k, f in ((2, "created"), (3, "updated")) for n, u in zip((r[0] for r in rows), ts.normalise_batch(pd.Series([r[k] for r in rows]), pd.Series([r[1] for r in rows]), table)) if u}
            assert got == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
