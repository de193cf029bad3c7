from __future__ import annotations

from datetime import datetime, timezone
from zoneinfo import ZoneInfo

from plumbline.operators.timestamps import all_instants, custody_instants, frame_instants, timeline_instants

SOURCES = [("R1", "recorder", "Europe/Berlin"), ("R2", "recorder", None), ("S1", "station", "America/New_York")]


def us(*parts: int, zone: str = "UTC", fold: int = 0, micro: int = 0) -> int:
    t = datetime(*parts, tzinfo=ZoneInfo(zone), fold=fold).astimezone(timezone.utc)
    return int(t.timestamp()) * 1_000_000 + micro


def sources(spark):
    return spark.createDataFrame(SOURCES, "source_id string, source_kind string, clock_zone string")


def test_forms(spark):
    cases = {
        "2026-11-05t01:12:34.313z": us(2026, 11, 5, 1, 12, 34, micro=313_000), "2024-10-16T08:13:21.376581320Z": us(2024, 10, 16, 8, 13, 21, micro=376_581), "2026-11-05 14:05:02+1030": us(2026, 11, 5, 3, 35, 2),
        "20230419T134825Z": us(2023, 4, 19, 13, 48, 25), "Mon, 18 Mar 2024 12:14:10 GMT": us(2024, 3, 18, 12, 14, 10), "1719260518": 1_719_260_518_000_000, "1692326489560": 1_692_326_489_560_000,
        "22 Nov 2026 12:24:15 AM": us(2026, 11, 22, 0, 24, 15, zone="America/New_York"), " 2023.8.4 7:42:01 ": us(2023, 8, 4, 7, 42, 1, zone="America/New_York"), "2023-03-12 00:43:03 EST": us(2023, 3, 12, 5, 43, 3),
        "2024-11-03 01:30:00": us(2024, 11, 3, 1, 30, zone="America/New_York"), "2024-03-10 02:30:00": us(2024, 3, 10, 7, 30),  # twice: the first; skipped: by the offset before
        "2023-05-11 05:06:42,292": us(2023, 5, 11, 5, 6, 42, zone="America/New_York", micro=292_000), "2026-13-01 00:00:00Z": None, "0000-00-00 00:00:00": None, "unknown": None, "": None, "2026-01-01 00:00:00 XQZ": None, "2026-02-30 10:00:00": None,
    }
    rows = [(k, "S1", text) for k, text in enumerate(cases)] + [(100, "S1", None), (101, "R2", "2024-01-01 00:00:00"), (102, "none", "2024-01-01 00:00:00"), (None, "S1", "2024-01-01 00:00:00")]
    got = {r["row_no"]: r["utc_us"] for r in custody_instants(spark.createDataFrame(rows, "event_id long, station_id string, timestamp_utc string"), sources(spark)).collect()}
    assert got == {k: v for k, v in enumerate(cases.values()) if v is not None}


def test_order_of_frames_settles_times_that_occur_twice(spark):
    clock = ["2024-10-27 02:59:58", "2024-10-27 02:59:59", "--", "2024-10-27 02:00:00", "2024-10-27 02:00:01"]
    rows = [("e", "v", k, "R1", t, 10 + k) for k, t in enumerate(clock)] * 2
    df = spark.createDataFrame(rows, "evidence_id string, video_id string, frame_index int, recorder_id string, device_time string, seq long")
    want = {10: us(2024, 10, 27, 2, 59, 58, zone="Europe/Berlin"), 11: us(2024, 10, 27, 2, 59, 59, zone="Europe/Berlin"), 13: us(2024, 10, 27, 2, 0, 0, zone="Europe/Berlin", fold=1), 14: us(2024, 10, 27, 2, 0, 1, zone="Europe/Berlin", fold=1)}
    for hot in ({}, {"hot_rows": 2, "fan": 3}):
        assert {r["row_no"]: r["utc_us"] for r in frame_instants(df, sources(spark), **hot).collect()} == want


def test_the_second_hour_lasts_to_its_end_and_starts_at_the_first_fall(spark):
    # per video: (clock, is it the second of the two)
    videos = {
        "long": [("2024-10-27 02:59:59", 0), ("2024-10-27 02:00:00", 1), ("2024-10-27 02:29:59", 1), ("--", None), ("2024-10-27 02:30:00", 1), ("2024-10-27 02:45:00", 1), ("2024-10-27 02:59:59", 1), ("2024-10-27 03:00:00", 0)],
        "gap": [("2024-10-27 02:19:50", 0), ("2024-10-27 02:20:00", 0), ("2024-10-27 02:05:00", 1), ("2024-10-27 02:40:00", 1)],
        "jitter": [("2024-10-27 02:10:04", 0), ("2024-10-27 02:10:02", 0), ("2024-10-27 02:30:00", 0), ("2024-10-27 02:29:58", 0)],
        "two years": [("2023-10-29 02:50:00", 0), ("2023-10-29 02:10:00", 1), ("2024-10-27 02:20:00", 0), ("2024-10-27 02:50:00", 0)],
    }
    rows, want = [], {}
    for v, (video, clock) in enumerate(videos.items()):
        for k, (text, fold) in enumerate(clock):
            rows.append(("e", video, k, "R1", text, 100 * v + k))
            if fold is not None:
                want[100 * v + k] = us(*map(int, text.replace("-", " ").replace(":", " ").split()), zone="Europe/Berlin", fold=fold)
    df = spark.createDataFrame(rows * 2, "evidence_id string, video_id string, frame_index int, recorder_id string, device_time string, seq long")
    for hot in ({}, {"hot_rows": 2, "fan": 3}):
        assert {r["row_no"]: r["utc_us"] for r in frame_instants(df, sources(spark), **hot).collect()} == want


def test_units(spark):
    rows = [(1, 7_071_769, 1_793_542_673_209_106), (2, 1_676_925_883, None), (3, 1_673_319_959_120, None), (4, 1_673_289_805_087_270, None), (5, 1_673_966_887_807_645_015, None), (6, -1, None), (7, None, 5), (8, 0, 7)]
    got = {r["row_no"]: r["utc_us"] for r in timeline_instants(spark.createDataFrame(rows, "seq long, timestamp_us long, boot_utc_us long")).collect()}
    assert got == {1: 1_793_542_680_280_875, 2: 1_676_925_883_000_000, 3: 1_673_319_959_120_000, 4: 1_673_289_805_087_270, 5: 1_673_966_887_807_645}


def test_empty(spark):
    f = spark.createDataFrame([], "evidence_id string, video_id string, frame_index int, recorder_id string, device_time string, seq long")
    c = spark.createDataFrame([], "event_id long, station_id string, timestamp_utc string")
    t = spark.createDataFrame([], "seq long, timestamp_us long, boot_utc_us long")
    assert all_instants(f, c, t, sources(spark).limit(0)).count() == 0
