"""Samples, grids, windows and their transforms on small cases with expected results."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import geo
from plumbline.functions.clocks import irregular_offset
from plumbline.operators import forecasts, statistics, trajectories

SCHEMA = "evidence_id string, seq long, timestamp double, x_m double, y_m double, z_m double, vx_m_s double, vy_m_s double, vz_m_s double, position_valid boolean, velocity_valid boolean, vertical_reset_counter int, chunk string"


def flight(spark, times, valid=None, resets=None, velocity=True, speed=1.0):
    rows = []
    for k, t in enumerate(times):
        v = speed if velocity else None
        rows.append(("a", k, t, speed * t, 0.0, 0.0, v, 0.0 if velocity else None, 0.0 if velocity else None, valid is None or valid[k], velocity, 0 if resets is None else resets[k], "clash"))
    return spark.createDataFrame([*rows, rows[0]], SCHEMA)


def grid(df, us=100_000, **hot):
    return trajectories.on_grid(trajectories.samples(df, us / 1e6, **hot), us)


def ends(df, h, p, us=100_000):
    w = forecasts.forecast_windows(grid(df, us), h, p, us)
    return sorted(round(r["at_us"] / 1e6, 3) for r in w.collect())


def test_windows_stay_in_segments_and_chunks(spark):
    tenths = [round(0.1 * k, 1) for k in range(10)]
    # two segments of five: one window each, of three and two
    assert ends(flight(spark, tenths, resets=[0] * 5 + [1] * 5), 3, 2) == [0.2, 0.7]
    assert ends(flight(spark, tenths[:5] + [2.0, 2.1, 2.2, 2.3, 2.4]), 3, 2) == [0.2, 2.2]
    assert len(ends(flight(spark, [round(0.1 * k, 1) for k in range(12)]), 3, 2)) == 8
    assert len(ends(flight(spark, tenths, valid=[k != 5 for k in range(10)]), 2, 2)) == 3
    # a repeated time breaks too; one sample alone has no window
    assert ends(flight(spark, [0.0, 0.1, 0.1, 0.2]), 2, 1) == [] and ends(flight(spark, [0.0]), 1, 1) == []


def test_observations_are_held_and_targets_interpolated(spark):
    g = {r["k"]: r for r in grid(flight(spark, [0.0, 0.14, 0.27, 0.41])).collect()}
    assert sorted(g) == [0, 1, 2, 3, 4]
    assert [g[k]["x_m"] for k in range(5)] == [0.0, 0.0, 0.14, 0.27, 0.27]
    assert [round(g[k]["target_x_m"], 9) for k in range(5)] == [0.0, 0.1, 0.2, 0.3, 0.4]


def test_derived_velocity(spark):
    times = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5]
    df = flight(spark, times, valid=[k != 2 for k in range(6)], resets=[0, 0, 0, 0, 1, 1], velocity=False, speed=3.0)
    got = {r["seq"]: r for r in trajectories.samples(df, 0.1).collect()}
    assert {k: round(r["vx_m_s"], 6) for k, r in got.items()} == {0: 0.0, 1: 3.0, 3: 0.0, 4: 0.0, 5: 3.0}
    assert len({r["segment"] for r in got.values()}) == 3
    f = trajectories.features(trajectories.samples(df, 0.1)).where("seq = 5").head()
    assert round(f["speed_m_s"], 6) == 3.0 and f["heading_sin"] == 0.0 and f["heading_cos"] == 1.0


def test_cut_logs_give_the_same_grid(spark):
    times = [round(0.43 * k + (5 if k > 90 else 0), 2) for k in range(150)]
    df = flight(spark, times, valid=[k % 47 != 0 for k in range(150)], resets=[k // 60 for k in range(150)])
    rows = lambda **hot: sorted(tuple(r) for r in grid(df, 1_000_000, **hot).collect())
    assert rows() == rows(hot_rows=40, fan=4) and len(rows()) > 50


def test_constant_velocity_is_exact_and_targets_come_back(spark):
    df = flight(spark, [round(0.1 * k, 1) for k in range(60)], resets=[int(k >= 10) for k in range(60)], speed=-2.0)
    w = forecasts.forecast_windows(grid(df), 4, 3, 100_000)
    worst = forecasts.forecast_errors(w, 100_000).agg(F.max("error_m"), F.count_distinct("motion"), F.first("motion")).head()
    assert worst[0] < 1e-9 and worst[1] == 1 and worst[2] == "moving"
    for frame, target in (("global", "absolute"), ("centered", "relative"), ("heading", "residual_velocity"), ("heading", "residual_acceleration")):
        back = forecasts.restored(forecasts.transformed(w, frame, target, 100_000), w, target, 100_000)
        want = {(r["k"], r["chunk"], k + 1): t["x_m"] for r in w.collect() for k, t in enumerate(r["targets"])}
        assert all(abs(r["x_m"] - want[r["k"], r["chunk"], r["step"]]) < 1e-9 and abs(r["y_m"]) < 1e-9 for r in back.collect())
    turned = forecasts.transformed(w, "heading", "relative", 100_000).where("step = 3").head()
    assert abs(turned["angle"] - math.pi) < 1e-9 and abs(turned["dx_m"] - 0.6) < 1e-9
    with pytest.raises(ValueError):
        forecasts.transformed(w, "heading", "absolute")


def test_latest_history(spark):
    df = flight(spark, [0.0, 0.1, 0.2, 0.3, 0.44])
    latest = lambda d, n, cut=None: sorted((r["step"], round(r["at_us"] / 1e6, 3), r["x_m"]) for r in trajectories.latest_history(trajectories.samples(d if cut is None else d.where(f"timestamp <= {cut}"), 0.1), d, n, 100_000, cut).collect())
    assert latest(df, 3) == [(0, 0.44, 0.44), (1, 0.34, 0.3), (2, 0.24, 0.2)]
    assert latest(df, 3, 0.25) == [(0, 0.2, 0.2), (1, 0.1, 0.1), (2, 0.0, 0.0)]
    assert latest(df, 9) == [] and latest(flight(spark, [0.0, 0.1, 0.2], valid=[True, True, False]), 2) == []


def test_quantiles_of_counts(spark):
    df = spark.createDataFrame([("a", v) for v in (5, 1, 1, 9, None)] + [("b", 7)], "evidence_id string, v long")
    got = {r["evidence_id"]: r for r in trajectories.exact_quantiles(df, ["evidence_id"], ["v"], {"median": 0.5, "p95": 0.95}).collect()}
    assert (got["a"]["count"], got["a"]["least"], got["a"]["greatest"], got["a"]["total"], got["a"]["median"]) == (4, 1, 9, 16, 3.0)
    assert abs(got["a"]["p95"] - 8.4) < 1e-9 and got["b"]["p95"] == 7.0


def test_runs_and_pairs(spark):
    rows = [(run, m, f, v + run) for run in range(2) for m, v in (("a", 1.0), ("b", 3.0)) for f in ("x", "y")]
    df = spark.createDataFrame(rows, "run int, model string, flight string, value double")
    got = {r["model"]: r for r in statistics.over_runs(df).collect()}
    assert got["a"]["macro_m"] == 1.5 and got["a"]["flights"] == 2 and abs(got["a"]["deviation_m"] - math.sqrt(0.5)) < 1e-6
    assert statistics.over_runs(df.where("run = 0")).head()["deviation_m"] is None
    pairs = statistics.paired(df, "a", "b")
    assert {r["difference_m"] for r in pairs.collect()} == {-2.0}
    r = statistics.bootstrap_interval(pairs, "difference_m", 50).head()
    assert (r["groups"], r["mean"], r["low"], r["high"]) == (2, -2.0, -2.0, -2.0)
    assert statistics.bootstrap_interval(pairs.limit(1), "difference_m", 50).head()["low"] is None


def test_first_and_last_and_agreement(spark):
    df = spark.createDataFrame([("a", k) for k in range(5)] + [("b", 9)], "evidence_id string, seq long")
    got = sorted((r["evidence_id"], r["place"], r["seq"]) for r in statistics.first_and_last(df, ["evidence_id"], ["seq"], 2, 1).collect())
    assert got == [("a", -1, 4), ("a", 1, 0), ("a", 2, 1), ("b", -1, 9), ("b", 1, 9)]
    e, d = (spark.createDataFrame([(x,) for x in s], "id string") for s in ("ab", "bc"))
    r = statistics.confusion(e, d, ["id"], spark.createDataFrame([(x,) for x in "abcdef"], "id string")).head()
    assert tuple(r)[:4] == (1, 1, 1, 3) and r["precision"] == 0.5 and r["false_positive_rate"] == 0.25
    none = statistics.confusion(e.limit(0), d.limit(0), ["id"]).head()
    assert (none["f1"], none["true_negatives"], none["false_positive_rate"]) == (0.0, 0, 0.0)


def test_places_written_as_text(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["47° 38' 37.27\" N", "16 28 33 W", "91 0 0 N", "12 75 0 E", "nowhere", None, "7°E"])], "k int, t string")
    got = [r["v"] for r in df.select("k", geo.degrees_of(F.col("t")).alias("v")).orderBy("k").collect()]
    assert abs(got[0] - 47.6436861) < 1e-6 and abs(got[1] + 16.4758333) < 1e-6 and got[2:6] == [None] * 4 and got[6] == 7.0
    iso = spark.createDataFrame([("+47.6436+016.4759+512.9/",), ("-35.5-181.0/",), ("+10.0+20.0",), ("x",), (None,)], "t string").select(geo.iso6709(F.col("t")).alias("p")).collect()
    assert tuple(iso[0]["p"]) == (47.6436, 16.4759, 512.9) and iso[1]["p"] is None and tuple(iso[2]["p"]) == (10.0, 20.0, None) and iso[3]["p"] is None and iso[4]["p"] is None


def test_frames_of_reference(spark):
    one = spark.range(1)
    c = lambda *v: tuple(F.lit(float(x)) for x in v)
    assert tuple(one.select(*geo.east_north_up(*c(10, 20, -3))).head()) == (20.0, 10.0, 3.0)
    half = math.sqrt(0.5)
    got = tuple(one.select(*geo.by_quaternion(c(half, 0, 0, half), c(1, 0, 0))).head())
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, (0.0, 1.0, 0.0), strict=True))
    assert tuple(one.select(*geo.by_quaternion(c(2, 0, 0, 0), c(1, 0, 0))).head()) == (None, None, None)
    odd = spark.createDataFrame([(0.0,), (3_600.0,), (5_430.0,), (5_500.0,), (60_000.0,), (None,)], "s double").select(irregular_offset(F.col("s")).alias("o")).collect()
    assert [r["o"] for r in odd] == [False, False, False, True, True, None]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert grid(df).count() == 0 and trajectories.latest_history(trajectories.samples(df), df, 3, 1_000_000).count() == 0
    assert forecasts.forecast_errors(forecasts.forecast_windows(grid(df), 3, 2, 100_000), 100_000).count() == 0
