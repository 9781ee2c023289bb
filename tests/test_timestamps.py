from datetime import datetime, timezone

import pytest

from tidewire.operators.timestamps import normalise_times


def ms(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp() * 1000)


CASES = [
    ("2025-09-07T22:15:33+01:00[Europe/London]", "gb", ms(2025, 9, 7, 21, 15, 33)), ("20250907T214033Z", "ng", ms(2025, 9, 7, 21, 40, 33)), ("22 Jun 25 11:45 +0100", "ng", ms(2025, 6, 22, 10, 45)),
    ("Mon, 8 Sep 2025 01:58:50 WAT", "ng", ms(2025, 9, 8, 0, 58, 50)), ("September 7, 2025 12:31 am", "us", ms(2025, 9, 7, 4, 31)), ("8 septembre 2025 à 09h10", "fr", ms(2025, 9, 8, 7, 10)),
    ("03/04/2025 05:06", "us", ms(2025, 3, 4, 10, 6)), ("03/04/2025 05:06:07", "gb", ms(2025, 4, 3, 4, 6, 7)), ("1757301647", "ng", 1757301647000), ("1757301647123", "ng", 1757301647123), ("2025-09-07", "ng", ms(2025, 9, 6, 23)),
    ("2025-09-08 13:48:17.588999+00", "ng", ms(2025, 9, 8, 13, 48, 17) + 588), ("2024-10-27 02:30:00", "fr", ms(2024, 10, 27, 0, 30)), ("2025-03-30 02:30:00", "fr", ms(2025, 3, 30, 1, 30)), ("2025-09-08T16:13", "zz", None),
    ("2025-09-08T16:13Z", "zz", ms(2025, 9, 8, 16, 13)), ("2025-02-30T00:00:00Z", "ng", None), ("2025-13-45T99:00:00Z", "ng", None), ("yesterday", "ng", None), ("", "ng", None), (None, "ng", None), ("2025-09-08T16:13:00+99:99", "ng", None), ("x" * 100_000, "ng", None),
]


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([("ng", "Africa/Lagos", "NG"), ("gb", "Europe/London", "GB"), ("us", "America/New_York", "US"), ("fr", "Europe/Paris", "FR"), ("zz", "No/Where", None), (None, "UTC", "US")], "id string, tz string, country string")


def test_formats_and_zones(spark, sources):
    rows = spark.createDataFrame([(i, t, s) for i, (t, s, _) in enumerate(CASES)], "id int, raw string, source string")
    got = {r.id: r.utc_ms for r in normalise_times(rows, "raw", "source", sources).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[2] for c in CASES]


def test_policies(spark, sources):
    rows = spark.createDataFrame([("2024-10-27 02:30:00", "fr"), ("2025-03-30 02:30:00", "fr"), ("2025-06-01 02:30:00", "fr")], "raw string, source string")
    got = [r.utc_ms for r in normalise_times(rows, "raw", "source", sources, ambiguous="later", nonexistent="null").orderBy("raw").collect()]
    assert got == [ms(2024, 10, 27, 1, 30), None, ms(2025, 6, 1, 0, 30)]
    with pytest.raises(ValueError):
        normalise_times(rows, "raw", "source", sources, ambiguous="both")


def test_empty_clashing_and_repeated(spark, sources):
    rows = spark.createDataFrame([("1757301647", None, 1, "n")] * 2, "raw string, source string, id int, tz string")
    got = normalise_times(rows, "raw", "source", sources)
    assert got.count() == 2 and got.columns == ["raw", "source", "id", "tz", "utc_ms"] and {r.utc_ms for r in got.collect()} == {1757301647000}
    assert normalise_times(rows.limit(0), "raw", "source", sources).count() == 0
