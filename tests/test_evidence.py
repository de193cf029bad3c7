"""Small cases of commands, events, findings and sidecars with their expected results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.operators import changes, indicators, matching
from plumbline.operators.pieces import sequenced
from plumbline.sources import sidecars

COMMANDS = "evidence_id string, seq long, command_timestamp_us long, command_id int, result string"
ACKS = "evidence_id string, seq long, timestamp_us long, command_id int, result int"


def sides(spark, commands, acks):
    c = [("a", k, int(t * 1e6), i, "x") for k, (t, i) in enumerate(commands)]
    a = [("a", 100 + k, int(t * 1e6), i, 2) for k, (t, i) in enumerate(acks)]
    return spark.createDataFrame(c, COMMANDS), spark.createDataFrame(a, ACKS)


@pytest.mark.parametrize(("commands", "acks", "lone", "unasked"), [
    ([(10.0, 521)], [(10.03, 521)], [], []),
    ([(10.0, 521)], [(9.996, 512)], [(0, 512, -4000)], []),
    ([], [(50.0, 512)], [], [100]),
    ([(10.0, 521)], [(100.0, 512)], [(0, None, None)], [100]),
    ([(10.0, None)], [(10.0, 512)], [], [100]),
    ([(10.0, 521)], [(12.0, None)], [(0, None, None)], []),
])
def test_commands_and_acknowledgements(spark, commands, acks, lone, unasked):
    c, a = sides(spark, commands, acks)
    assert [(r["command_seq"], r["nearest_ack_id"], r["delta_us"]) for r in matching.commands_without_ack(c, a).collect()] == lone
    assert [r["ack_seq"] for r in matching.acks_without_command(c, a).collect()] == unasked


def test_repeated_command(spark):
    c, a = sides(spark, [(10, 521), (20, 521), (30, 521), (40, 7)], [])
    assert [tuple(r) for r in matching.repeated(matching.sides(c, a)[0]).collect()] == [("a", 521, 3, 10_000_000, 30_000_000, 0)]


@pytest.mark.parametrize(("rows", "want"), [
    ([(10, True), (11, True), (12, True), (13, False)], [(10, 12, 13, False, 3)]),
    ([(20, False), (21, True), (22, True)], [(21, 22, 22, True, 2)]),
    ([(1, True), (2, False)], [(1, None, 2, False, 1)]),
    ([(1, True), (2, None), (3, True), (4, False)], [(1, 3, 4, False, 2)]),
])
def test_flag_periods(spark, rows, want):
    df = spark.createDataFrame([("a", "f", k, t, v) for k, (t, v) in enumerate(rows)], "evidence_id string, field string, seq long, timestamp_us long, flag boolean")
    got = changes.flag_intervals(sequenced(df, ["evidence_id", "field"], "timestamp_us"), ["evidence_id", "field"], ["timestamp_us", "seq"], "flag", "timestamp_us")
    assert [(r["start"], r["last_true"], r["end"], r["open"], r["samples"]) for r in got.collect()] == want


def test_correlations_and_neighbours(spark):
    events = [
        ("a", 0, 1, "GCS_CONNECTION_STATE_CHANGE"), ("a", 400_000, 2, "DESCEND_STATE_CHANGE"), ("a", 900_000, 3, "NAVIGATION_STATE_CHANGE"), ("a", 9_000_000, 4, "VEHICLE_COMMAND"),
        ("a", 9_050_000, 5, "AT_REST_STATE_CHANGE"), ("a", 13_000_000, 6, "COMMAND_ACK"), ("b", 0, 7, "VEHICLE_COMMAND"),
    ]
    df = spark.createDataFrame(events, "evidence_id string, at_us long, seq long, event_type string")
    spans = {"tight": 100_000, "short": 500_000, "medium": 1_000_000, "wide": 5_000_000}
    got = {(r["seq"], r["span"]): (r["nearby"], r["relationship"].removesuffix("_TEMPORAL_PROXIMITY")) for r in indicators.correlations(df, spans).collect()}
    assert got[1, "short"] == (1, "GCS_AND_DESCEND") and got[1, "wide"] == (2, "GCS_AND_DESCEND") and (1, "tight") not in got
    assert got[2, "wide"] == (2, "GENERAL") and got[4, "tight"] == (1, "GENERAL") and got[4, "wide"] == (2, "COMMAND_ACK") and got[6, "wide"] == (2, "GENERAL")
    assert not any(k in got for k in ((5, "tight"), (7, "wide")))
    near = [(r["place"], r["near_seq"], r["span"]) for r in indicators.neighbours(df, spans).where("seq = 1").orderBy("place").collect()]
    assert near == [(1, 2, "short"), (2, 3, "medium")]


def test_findings_whole_and_cut(spark):
    rows = [("a", "GPS_JAMMING_STATE" if k % 3 else "ACK_WITHOUT_COMMAND", "gps", k, 10 * k, None, k) for k in range(60)] + [("b", "NO_GPS_RECORDS", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "evidence_id string, indicator_type string, source string, seq long, at_us long, end_us long, place long")
    found = lambda **hot: sorted(tuple(r) for r in indicators.findings(df, df, **hot).collect())
    whole = found()
    assert whole == found(hot_rows=10, fan=4) and len(whole) == 61
    of = {r[-1]: r[1] for r in whole}
    assert of["gps:1"] == "FINDING-0001" and of["gps:59"] == "FINDING-0040" and of["gps:0"] == "FINDING-0041" and of[None] == "FINDING-0001"


def cue(k, body):
    return f"{k}\n00:00:0{k},000 --> 00:00:0{k},500\n{body}\n\n"


@pytest.mark.parametrize(("text", "order", "with_position"), [
    (cue(1, "[latitude: 47.5] [longitude: 16.4] [rel_alt: 9.2 abs_alt: 97.2]"), "keyed", 1),
    (cue(1, "HOME(149.02,-20.25) GPS(149.02,-20.25,16) BAROMETER:1.9"), "lon_lat", 1),
    (cue(1, "GPS(-20.25,149.02,16)") + cue(2, "GPS(0,0,1)"), "lat_lon", 1),
    (cue(1, "GPS(47.5,16.4,16)"), "ambiguous", 0),
    (cue(1, "GPS(147.5,116.4,16)"), "inconsistent", 0),
    (cue(1, "GPS(147.5,16.4,16)") + cue(2, "GPS(16.4,147.5,16)"), "inconsistent", 0),
    (cue(1, "[latitude: 47.5] [longtitude: 16.4]") + cue(2, "GPS(16.4001,47.5001,16)"), "lon_lat", 2),
    (cue(1, "[latitude: 0] [longitude: 0] [iso : 100]"), "keyed", 0),
    (cue(1, "no telemetry"), "not_applicable", 0),
])
def test_axis_order_of_a_file(spark, text, order, with_position):
    docs = spark.createDataFrame([(1, text.replace("\n", "\r\n"), "drone_sidecar"), (2, None, "drone_sidecar"), (3, " ", "drone_sidecar"), (4, text, "web")], "doc_id long, text string, source string")
    got = [r for r in sidecars.summaries(docs).collect() if r["frames"]]
    assert [(r["doc_id"], r["axis_order"], r["with_position"]) for r in got] == [(1, order, with_position)]
    assert sidecars.frames(docs).where("latitude is not null").count() == with_position


def test_fields_of_a_cue(spark):
    body = "<font>F/2.8, SS 206, GPS (16.4,147.5,21.3M), D 24.26m, H 6.00m, H.S 2.10m/s, V.S -0.50m/s, F.PRY (1.0°, 2.0°, 3.0°), G.PRY (-4.0°, 0.0°, 6.5°)</font>\n2023.1.7 03:51:44,6"
    docs = spark.createDataFrame([(1, cue(7, body), "drone_sidecar")], "doc_id long, text string, source string")
    r = sidecars.frames(docs).head()
    assert (r["cue"], r["frame"], r["start_s"], r["end_s"], r["device_time"]) == (7, 1, 7.0, 7.5, "2023-01-07T03:51:44.600")
    assert (r["latitude"], r["longitude"], r["altitude_m"], r["third"]) == (16.4, 147.5, 21.3, None)
    assert (r["distance_from_home_m"], r["height_m"], r["horizontal_speed_m_s"], r["vertical_speed_m_s"], r["aircraft_yaw"], r["gimbal_pitch"]) == (24.26, 6.0, 2.1, -0.5, 3.0, -4.0)
    stated = sidecars.frames(docs, order="lon_lat").head()
    assert stated["latitude"] is None and stated["axis_order"] == "lon_lat"


def test_severity_of_flags(spark):
    names = ["motor_failure", "gcs_connection_lost", "wind_limit_exceeded", None]
    df = spark.createDataFrame([(n,) for n in names], "field string")
    assert [r["s"] for r in df.select(indicators.flag_severity(F.col("field")).alias("s")).collect()] == ["HIGH", "MEDIUM", "LOW", None]
