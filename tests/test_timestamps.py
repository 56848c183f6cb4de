from __future__ import annotations

from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from presswerk.operators.timestamps import normalize_timestamps, published_instants, utc_text

CASES = [
    ("2025-09-10T10:00:00Z", "Europe/Zurich", "de-CH", "2025-09-10T10:00:00Z"),
    ("2025-09-10T10:00:00.999+02:00", "Europe/Zurich", "de-CH", "2025-09-10T08:00:00Z"),
    ("2025-09-10T10:00:00.351+0200", "UTC", "de-CH", "2025-09-10T08:00:00Z"),
    ("2025-09-10 10:00", "America/New_York", "en-US", "2025-09-10T14:00:00Z"),
    ("  2025-09-10T10:00:00.123456789Z ", "Europe/Zurich", "de-CH", "2025-09-10T10:00:00Z"),
    ("20250910T053152Z", "Europe/Zurich", "de-CH", "2025-09-10T05:31:52Z"),
    ("Wed, 10 Sep 2025 01:03:18 +0200", "UTC", "de-CH", "2025-09-09T23:03:18Z"),
    ("Wed, 10 Sep 2025 02:46:14 GMT", "Europe/Zurich", "fr-CH", "2025-09-10T02:46:14Z"),
    ("10. März 2026, 10:01 Uhr", "Europe/Zurich", "de-CH", "2026-03-10T09:01:00Z"),
    ("1er décembre 2025 à 3h34", "Europe/Zurich", "fr-CH", "2025-12-01T02:34:00Z"),
    ("16 settembre 2025, ore 08:57", "Europe/Zurich", "it-CH", "2025-09-16T06:57:00Z"),
    ("September 10, 2025 12:05 AM", "Europe/London", "en-GB", "2025-09-09T23:05:00Z"),
    ("10 Sep 2025 04:34 CEST", "Europe/Zurich", "fr-CH", "2025-09-10T02:34:00Z"),
    ("10/11/2025 8:23 AM", "America/New_York", "en-US", "2025-10-11T12:23:00Z"),
    ("10/11/2025 08:23", "Europe/Zurich", "fr-CH", "2025-11-10T07:23:00Z"),
    ("16.9.25 14:05", "Europe/Zurich", "de-CH", "2025-09-16T12:05:00Z"),
    ("1757488543", "Europe/Zurich", "de-CH", "2025-09-10T07:15:43Z"),
    ("1757488543302", "Europe/Zurich", "de-CH", "2025-09-10T07:15:43Z"),
    ("2025-09-10", "Asia/Singapore", "en-SG", "2025-09-09T16:00:00Z"),
    ("2025-10-26T02:30:00", "Europe/Zurich", "de-CH", "2025-10-26T00:30:00Z"),
    ("2026-03-29T02:30:00", "Europe/Zurich", "de-CH", "2026-03-29T01:30:00Z"),
    ("2025-09-10T09:25:32+02:00[Europe/Zurich]", "UTC", "de-CH", "2025-09-10T07:25:32Z"),
    *[(t, "Europe/Zurich", "de-CH", None) for t in ("gestern", "vor 3 Stunden", "31.02.2025 10:00", "2025-13-01T00:00:00Z", "0000-00-00 00:00:00", "", "  ", "n/a", "04:47", "25:00", "12/13/2025", "x" * 5000)],
    ("13/12/2025", "America/New_York", "en-US", None),
    ("2025-09-10 10:00", None, None, None),
    ("2025-09-10 10:00Z", None, None, "2025-09-10T10:00:00Z"),
    (None, "Europe/Zurich", "de-CH", None),
]


def test_forms(spark):
    df = spark.createDataFrame([(i, *c[:3], "old") for i, c in enumerate(CASES)], "n int, raw string, tz string, loc string, instant string")
    got = {r["n"]: r["u"] for r in normalize_timestamps(df, "raw", "tz", "loc").select("n", utc_text(F.col("instant")).alias("u")).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[3] for c in CASES]


def test_every_hour_of_a_year_agrees_with_zoneinfo(spark):
    rows, want = [], {}
    for zone in ("Europe/Zurich", "America/New_York", "Europe/London", "Asia/Singapore"):
        for k in range(0, 366 * 24 * 2, 3):
            local = datetime(2025, 1, 1 + k // 48 % 28, k % 48 // 2, 30 * (k % 2)).replace(month=1 + k // 48 // 28 % 12)
            text = local.strftime("%Y-%m-%d %H:%M:%S")
            rows.append((text, zone, "x"))
            want[(text, zone)] = local.replace(tzinfo=ZoneInfo(zone)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    df = spark.createDataFrame(rows, "raw string, tz string, loc string")
    for r in normalize_timestamps(df, "raw", "tz", "loc").select("raw", "tz", utc_text(F.col("instant")).alias("u")).collect():
        assert r["u"] == want[(r["raw"], r["tz"])]


def test_dictionary_is_extended_not_parsed_again(spark, tmp_path):
    path = str(tmp_path / "dict")
    first = spark.createDataFrame([("2025-09-10", "UTC", "x")] * 3, "raw string, tz string, loc string")
    assert normalize_timestamps(first, "raw", "tz", "loc", path).filter("instant IS NOT NULL").count() == 3
    both = first.unionByName(spark.createDataFrame([("2025-09-11", "UTC", "x"), ("gestern", "UTC", "x")], first.schema))
    assert normalize_timestamps(both, "raw", "tz", "loc", path).filter("instant IS NOT NULL").count() == 4
    assert spark.read.parquet(path).count() == 3


def test_empty_and_repeated(spark):
    articles = spark.createDataFrame([(1, "a", "2025-09-10"), (1, "a", "2025-09-10"), (2, "b", "2025-09-10 10:00"), (None, None, None)], "id int, source string, published_at string")
    feeds = spark.createDataFrame([("a", "UTC", "de-CH"), ("a", "UTC", "de-CH")], "name string, tz_name string, locale_code string")
    assert [tuple(r) for r in published_instants(articles, feeds).collect()] == [(1, "2025-09-10T00:00:00Z")]
    assert published_instants(articles.limit(0), feeds).count() == 0


@pytest.mark.parametrize("zone", ["Asia/Tokyo", "America/New_York"])
def test_text_does_not_depend_on_the_session(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert spark.range(1).select(utc_text(F.timestamp_seconds(F.lit(1757488543))).alias("u")).first()["u"] == "2025-09-10T07:15:43Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
