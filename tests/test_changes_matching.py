from __future__ import annotations

from plumbline.operators import changes, matching, statistics
from plumbline.operators.pieces import sequenced

ROW = "k string, seq long, t long, v int, flag boolean, piece string"


def rows(spark):
    data = [("a", 1, 1, 1, None), ("a", 2, 2, None, True), ("a", 3, 3, 1, True), ("a", 4, 4, 2, None), ("a", 5, 5, 2, False), ("a", 6, 6, None, False), ("a", 7, 7, 3, True), ("b", 8, 1, 5, None), (None, 9, 1, 1, True), ("b", 10, None, 6, True)]
    return spark.createDataFrame([(*r, "clash") for r in [*data, data[2]]], ROW)


def test_policies_whole_and_cut(spark):
    want = {"skip": {4, 7}, "value": {2, 3, 4, 6, 7}, "held": {2, 4, 6}, "both": {4}}
    for hot in ({}, {"hot_rows": 2, "fan": 4}):
        s = sequenced(rows(spark).drop("piece"), ["k"], "t", **hot)
        for policy, seqs in want.items():
            assert {r["seq"] for r in changes.changes(s, ["k"], ["t", "seq"], "v", policy).collect()} == seqs, (policy, hot)
        assert sorted((r["seq"], r["edge"]) for r in changes.edges(s, ["k"], ["t", "seq"], "flag").collect()) == [(5, "CLEARED"), (7, "ASSERTED")]
        got = sorted((r["start"], r["last_true"], r["end"], r["open"], r["samples"]) for r in changes.flag_intervals(s, ["k"], ["t", "seq"], "flag", "t").collect())
        assert got == [(2, 3, 5, False, 2), (7, None, 7, True, 1)]


def test_bursts(spark):
    df = spark.createDataFrame([("a", k, t, "x" if k % 2 else "y") for k, t in enumerate((0, 1, 1, 5, 300, 301))], "k string, seq long, t long, kind string")
    from pyspark.sql import functions as F

    got = {r["seq"]: (r["near_nearby"], r["wide_nearby"], r["near_x"]) for r in changes.burst_counts(df, ["k"], "t", {"near": 1, "wide": 5}, {"x": F.col("kind") == "x"}).collect()}
    assert got == {0: (2, 3, 1), 1: (2, 3, 1), 2: (2, 3, 1), 3: (0, 3, 1), 4: (1, 1, 1), 5: (1, 1, 1)}


def test_as_of_both_ways(spark):
    from pyspark.sql import functions as F

    left = spark.createDataFrame([("a", k, t) for k, t in enumerate((5, 10, 15, None))] + [(None, 9, 5)], "k string, seq long, at_us long")
    right = spark.createDataFrame([("a", 1, 10), ("a", 0, 10), ("a", 2, 12), (None, 3, 5)], "k string, seq long, at_us long")
    for hot in ({}, {"hot_rows": 1, "fan": 3}):
        back = {r["seq"]: r["x"] for r in matching.as_of(left, right, ["k"], F.col("seq"), "x", **hot).collect()}
        on = {r["seq"]: r["x"] for r in matching.as_of(left, right, ["k"], F.col("seq"), "x", "forward", **hot).collect()}
        assert back == {0: None, 1: 0, 2: 2, 3: None, 9: None} and on == {0: 0, 1: 0, 2: None, 3: None, 9: None}


def test_statistics_of_nothing(spark):
    df = spark.createDataFrame([("a", None), ("a", float("nan")), ("b", 2.0)], "k string, v double")
    got = {r["k"]: (r["count"], r["minimum"], r["average"]) for r in statistics.range_statistics(df, ["k"], ["v"]).collect()}
    assert got == {"a": (0, None, None), "b": (1, 2.0, 2.0)}
    e = spark.createDataFrame([], "k string, v double")
    assert statistics.confusion(e, e, ["k"]).first()["f1"] == 0.0
    r = statistics.bootstrap_interval(spark.createDataFrame([(str(k), float(k)) for k in range(40)], "id string, v double"), "v", samples=300).first()
    assert r["mean"] == 19.5 and 14 < r["low"] < 19.5 < r["high"] < 25
    assert statistics.bootstrap_interval(e.withColumnRenamed("k", "id"), "v", samples=10).first()["low"] is None


def test_acks_near_a_command_of_another_id_are_its_mismatches(spark):
    commands = [("near", 1, 10_000_000, 521), ("far", 2, 10_000_000, 521), ("acknowledged", 3, 10_000_000, 521), ("no id", 4, 10_000_000, None), ("several", 5, 10_000_000, 521), ("edge", 6, 10_000_000, 521)]
    acks = [
        ("near", 11, 9_996_000, 512, 2), ("far", 12, 100_000_000, 512, 0), ("acknowledged", 13, 10_030_000, 521, 0), ("acknowledged", 14, 10_040_000, 512, 0), ("no id", 15, 10_010_000, 512, 0),
        ("several", 16, 9_000_000, 512, 0), ("several", 17, 11_000_000, 513, 0), ("edge", 18, 15_000_000, 512, 0), ("edge", 19, 15_000_001, 512, 0), ("lone", 20, 50_000_000, 512, 0), ("lone", 21, 50_000_000, None, 0),
    ]
    c = spark.createDataFrame(commands * 2, "evidence_id string, seq long, command_timestamp_us long, command_id int")
    a = spark.createDataFrame(acks * 2, "evidence_id string, seq long, timestamp_us long, command_id int, result int")
    assert sorted(r["ack_seq"] for r in matching.acks_without_command(c, a).collect()) == [12, 14, 15, 19, 20]
    # the commands themselves keep their nearest acknowledgement and its candidates
    got = {r["command_seq"]: (r["nearest_ack_seq"], r["candidates"]) for r in matching.commands_without_ack(c, a).collect()}
    # a command without id asks for no acknowledgement, so it lacks none
    assert got == {1: (11, 1), 2: (None, 0), 5: (16, 2), 6: (18, 1)}
