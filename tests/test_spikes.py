from __future__ import annotations

import numpy as np

from plumbline.operators import spikes
from plumbline.operators.spikes import gps_outliers, judge, trajectory_outliers

GPS = "evidence_id string, seq long, timestamp double, latitude double, longitude double, altitude_m double, speed_m_s double, piece int"


def test_spikes_bursts_and_stuck_runs():
    rng = np.random.default_rng(1)
    n = 400
    t, v = np.cumsum(rng.uniform(2, 4, n)), 100 + np.cumsum(rng.normal(0, 0.2, n)) + rng.normal(0, 0.3, n)
    wrong = np.zeros(n, bool)
    for at, width, off in ((50, 1, 20), (120, 3, -25), (200, 2, 400)):
        v[at : at + width] += off
        wrong[at : at + width] = True
    v[300:312] = v[300]
    stuck, spike, _ = judge(v[:, None], t, np.zeros(n, int), spikes.ALTITUDE)
    assert (spike == wrong).all() and stuck.sum() == 11 and stuck[301:312].all()


def test_coarse_sources_repeat_and_steps_across_gaps_are_genuine():
    rng = np.random.default_rng(2)
    t = np.cumsum(np.full(300, 2.0))
    v = np.round(50 + rng.normal(0, 0.4, 300))
    t[150:] += 500
    v[150:] += 80
    stuck, spike, _ = judge(v[:, None], t, np.zeros(300, int), spikes.ALTITUDE)
    assert not stuck.any() and not spike.any()


def gps_rows():
    rng = np.random.default_rng(3)
    rows = [(e, 1000 * g + k, 2.0 * k, 47 + rng.normal(0, 1e-6), 8 + rng.normal(0, 1e-6), 100 + rng.normal(0, 0.2), 0.1, 9) for g, e in enumerate("ab") for k in range(200)]
    rows[20] = (*rows[20][:3], 0.0, 0.0, -9999.0, 0.1, 9)
    rows[40] = (*rows[40][:3], 47.002, 8.0, None, 0.1, 9)
    rows[60] = (*rows[60][:3], 95.0, None, 140.0, 0.1, 9)
    rows[80] = (*rows[80][:3], None, 8.0, 100.0, None, 9)
    return [*rows, rows[40], ("c", 9001, None, 0.0, 0.0, 1.0, 1.0, 9), (None, 9002, 1.0, 0.0, 0.0, 0.0, 1.0, 9)]


def test_gps_whole_and_cut(spark):
    df = spark.createDataFrame(gps_rows(), GPS)
    want = {(20, "position"), (40, "position"), (60, "position"), (20, "altitude_m"), (60, "altitude_m"), (9002, "position")}
    assert {(r["seq"], r["field"]) for r in gps_outliers(df).collect()} == want
    got = [(r["seq"], r["field"]) for r in gps_outliers(df, hot_rows=50, fan=3).collect()]
    assert set(got) == want and len(got) == len(want)


def test_resets_are_genuine_and_empty(spark):
    schema = "evidence_id string, seq long, timestamp double, z_m double, vz_m_s double, vertical_reset_counter int"
    rows = [("a", k, 0.5 * k, 10.0 + 0.01 * (k % 3) + (15.0 if k >= 60 else 0.0), 0.0, int(k >= 60)) for k in range(120)]
    rows[30] = ("a", 30, 15.0, 60.0, 0.0, 0)
    assert [r["seq"] for r in trajectory_outliers(spark.createDataFrame(rows, schema)).collect()] == [30]
    assert trajectory_outliers(spark.createDataFrame([], schema)).count() == 0 and gps_outliers(spark.createDataFrame([], GPS)).count() == 0


def frozen(spark):
    """One log frozen for 250 of 1000 readings, longer than a piece of a fifth; one that holds
    coarse altitudes in one piece and fine ones elsewhere; one uncut."""
    rng = np.random.default_rng(4)
    rows = []
    for g, (name, n) in enumerate((("frozen", 1000), ("parked", 1000), ("short", 100))):
        lat, lon, alt = 47 + rng.normal(0, 2e-5, n), 8 + rng.normal(0, 2e-5, n), 100 + rng.normal(0, 0.3, n)
        if name == "frozen":
            lat[380:630], lon[380:630], alt[380:630] = lat[380], lon[380], alt[380]
        if name == "parked":
            alt[400:600] = np.repeat(alt[400:600:8], 8)[:200]
            alt[420:440:2] = alt[421:440:2]
        if name == "short":
            alt[50:60] = alt[50]
        rows += [(name, 10_000 * g + k, 5.0 * k, float(lat[k]), float(lon[k]), float(alt[k]), 0.1, 9) for k in range(n)]
    return spark.createDataFrame(rows * 2, GPS)


def test_frozen_for_more_than_a_piece_whole_and_cut(spark):
    from plumbline.operators.trips import stops_and_trips

    found = lambda **hot: sorted((r["seq"], r["field"]) for r in gps_outliers(frozen(spark), **hot).collect())
    trips = lambda **hot: sorted((r["evidence_id"], r["kind"], r["first_seq"], r["last_seq"]) for r in stops_and_trips(frozen(spark), **hot).collect())
    uncut = found()
    assert {(k, f) for k in range(381, 630) for f in ("position", "altitude_m")} <= set(uncut) and (20_055, "altitude_m") in uncut
    assert sum(10_400 <= k < 10_600 for k, _ in uncut) > 100
    for hot in ({"hot_rows": 200, "fan": 10}, {"hot_rows": 60, "fan": 5}):
        assert trips(**hot) == trips()
        assert found(**hot) == uncut


def test_noise_that_changes_whole_and_cut(spark):
    """Quiet for three quarters, noisy for one, with spikes in both, far and near."""
    rng = np.random.default_rng(8)
    n = 6000
    v = 100 + rng.normal(0, np.where(np.arange(n) < 4500, 0.2, 2.5))
    at = rng.choice(n, 120, replace=False)
    v[at] += rng.choice([-1, 1], 120) * rng.uniform(6, 60, 120)
    v[3000:3009], v[3700:3703] = v[3000], -9999.0
    rows = [("a", k, 2.0 * k, 47.0 + 1e-6 * (k % 7), 8.0, float(v[k]), 0.1, 9) for k in range(n)]
    df = spark.createDataFrame(rows, GPS)
    found = lambda **hot: sorted((r["seq"], r["field"]) for r in gps_outliers(df, **hot).collect())
    whole = found()
    assert len(whole) > 100 and found(hot_rows=700, fan=64) == whole and found(hot_rows=150, fan=4) == whole
