from __future__ import annotations

import numpy as np

from plumbline.operators.trips import settled, stay_points, stops_and_trips

SCHEMA = "evidence_id string, seq long, timestamp double, latitude double, longitude double, speed_m_s double, cut string"


def brute_stops(x, y, t, radius, least):
    stops, a = [], 0
    while a < len(t):
        b = a
        while b + 1 < len(t) and all((x[k] - x[b + 1]) ** 2 + (y[k] - y[b + 1]) ** 2 <= radius**2 for k in range(a, b + 1)):
            b += 1
        if t[b] - t[a] >= least:
            stops.append((a, b))
            a = b + 1
        else:
            a += 1
    return stops


def test_windows_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = 150
        speed = np.repeat(rng.choice([0.0, 0.3, 2.0, 9.0], n // 10), 10)
        x, y, t = np.cumsum(speed * 3 * rng.normal(1, 0.3, n)) + rng.normal(0, 2, n), rng.normal(0, 2, n), np.cumsum(rng.uniform(2, 5, n))
        want = brute_stops(x, y, t, 15.0, 60.0)
        assert stay_points(x, y, t, 15.0, 60.0)[0] == want
        # from a settled ping on, what came before doesn't matter
        at = settled(x, y, t, 15.0, 60.0, np.ones(n), 1.0)
        if at:
            rest = [(p + at[1], q + at[1]) for p, q in stay_points(x[at[1] :], y[at[1] :], t[at[1] :], 15.0, 60.0)[0]]
            assert rest == [w for w in want if w[1] >= at[0]]


def flight(spark, extra=()):
    rows, seq, t, lat = [], 0, 0.0, 47.0
    for speed, pings in ((0.0, 30), (10.0, 20), (0.0, 25)):
        for k in range(pings):
            rows.append(("a", seq, t, lat + 1e-6 * (seq % 3), 8.0, speed, "x"))
            seq, t, lat = seq + 1, t + 4.0, lat + speed * 4.0 / 111_320.0
    return spark.createDataFrame([*rows, rows[3], *extra], SCHEMA)


def test_stops_trips_and_silence(spark):
    late = [("a", 100, 700.0, 47.5, 8.0, 0.0, "x"), ("a", 101, 704.0, None, 8.0, 0.0, "x"), ("a", 102, None, 47.5, 8.0, 0.0, "x"), ("b", 103, 1.0, 0.0, 0.0, 0.0, "x")]
    for hot in ({}, {"hot_rows": 20, "fan": 4}):
        got = sorted((r["evidence_id"], r["kind"], r["first_seq"], r["last_seq"]) for r in stops_and_trips(flight(spark, late), **hot).collect())
        assert got == [("a", "stop", 0, 30), ("a", "stop", 50, 74), ("a", "trip", 30, 50), ("a", "trip", 100, 100)]


def test_distance_and_duration(spark):
    trip = next(r for r in stops_and_trips(flight(spark)).collect() if r["kind"] == "trip")
    assert abs(trip["distance_m"] - 800) < 2 and trip["duration_s"] == 80.0


def test_empty(spark):
    assert stops_and_trips(spark.createDataFrame([], SCHEMA)).count() == 0


def ways(spark):
    """Three logs at 10 Hz: in flight with stops, parked with noise about as wide as the radius,
    and frozen for long; some readings wrong, some stored twice."""
    rng = np.random.default_rng(11)
    rows = []
    for g, name in enumerate(("flown", "parked", "frozen")):
        n = 4000 if name == "flown" else 3000
        speed = {"flown": np.repeat([0.0, 9.0, 0.0, 9.0, 0.0], 800), "parked": np.zeros(n), "frozen": np.repeat([9.0, 0.0, 9.0], [500, 2000, 500])}[name]
        noise = {"flown": 1.0, "parked": 2.1, "frozen": 0.0}[name]
        lat = 47 + (np.cumsum(speed * 0.1) + rng.normal(0, noise, n)) / 111_320.0
        lon = 8 + rng.normal(0, noise + 0.01, n) / 76_000.0
        if name == "frozen":
            lat[700:2300], lon[700:2300] = lat[700], lon[700]
        bad = rng.choice(n, 12, replace=False)
        lat[bad] += 0.01
        rows += [(name, 100_000 * g + k, round(0.1 * k + (400 if name == "flown" and k > 2500 else 0), 3), float(lat[k]), float(lon[k]), float(speed[k]), "x") for k in range(n)]
    return spark.createDataFrame(rows + rows[::97], SCHEMA)


def test_dense_logs_whole_and_cut(spark):
    df = ways(spark)
    found = lambda **hot: sorted((r["evidence_id"], r["kind"], r["first_seq"], r["last_seq"], round(r["distance_m"], 3)) for r in stops_and_trips(df, **hot).collect())
    whole = found()
    assert {k for _, k, *_ in whole} == {"stop", "trip"} and len(whole) >= 10
    assert found(hot_rows=200, fan=16) == whole
    # cut twice, into pieces of pieces
    assert found(hot_rows=100, fan=6) == whole


def test_parked_for_long_takes_linear_time():
    import time

    rng = np.random.default_rng(2)
    took = []
    for n in (20_000, 160_000):
        x, y, t = rng.normal(0, 3, n), rng.normal(0, 3, n), 0.1 * np.arange(n)
        began = time.perf_counter()
        stay_points(x, y, t, 15.0, 60.0)
        took.append(time.perf_counter() - began)
    assert took[1] < 24 * took[0]
