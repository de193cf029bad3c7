from __future__ import annotations

import random

from plumbline.operators.grid import regular_grid
from plumbline.operators.nearest import nearest


def test_nearest_against_brute_force(spark):
    rnd = random.Random(3)
    left = [(rnd.choice(["a", "b", None]), k, rnd.randrange(0, 400) if k % 17 else None, "x") for k in range(300)]
    right = [(rnd.choice(["a", "b", None]), k, rnd.randrange(0, 400) if k % 13 else None, 1) for k in range(200)]
    got = {(r["left_seq"], r["right_seq"]) for r in nearest(spark.createDataFrame(left + left[:9], "key string, seq long, at_us long, bin string"), spark.createDataFrame(right + right[:9], "key string, seq long, at_us long, low2 int"), ["key"], 6).collect()}
    want = set()
    for lk, ls, lt, _ in left:
        near = sorted((abs(rt - lt), rs) for rk, rs, rt, _ in right if rk and rk == lk and rt is not None and lt is not None and abs(rt - lt) <= 6)
        if near:
            want.add((ls, near[0][1]))
    assert got == want


def test_nearest_of_a_table_with_itself_and_empty(spark):
    t = spark.createDataFrame([("a", 1, 10), ("a", 2, 10), ("a", 3, 14)], "key string, seq long, at_us long")
    assert sorted((r["left_seq"], r["right_seq"]) for r in nearest(t, t, ["key"], 2).collect()) == [(1, 1), (2, 1), (3, 3)]
    assert nearest(t.limit(0), t, ["key"], 2).count() == 0 and nearest(t, t.limit(0), ["key"], 2).count() == 0


GRID = "evidence_id string, seq long, timestamp double, x_m double, vx_m_s double, position_valid boolean, velocity_valid boolean, slot string"


def test_grid(spark):
    rows = [
        ("a", 1, 10.2, 1.0, 5.0, True, True, "x"), ("a", 1, 10.2, 1.0, 5.0, True, True, "x"), ("a", 2, 10.7, 3.0, None, True, True, "x"), ("a", 3, 12.5, 9.0, 5.0, True, None, "x"),
        ("a", 4, 13.5, 9.0, 5.0, False, True, "x"), ("a", 5, 30.0, float("nan"), 1.0, True, True, "x"), (None, 6, 1.0, 1.0, 1.0, True, True, "x"), ("b", 7, None, 1.0, 1.0, True, True, "x"),
    ]
    got = {(r["field"], r["slot"]): (r["state"], r["value"]) for r in regular_grid(spark.createDataFrame(rows, GRID)).collect()}
    assert len(got) == 42
    assert got["x_m", 10] == ("observed", 2.0) and got["x_m", 12] == ("observed", 9.0)
    state, value = got["x_m", 11]
    assert state == "interpolated" and abs(value - (3 + 6 * 0.8 / 1.8)) < 1e-9
    assert got["x_m", 13][0] == got["x_m", 30][0] == "missing" and got["vx_m_s", 12] == ("interpolated", 5.0) and got["vx_m_s", 20][0] == "missing"


def test_grid_over_bins(spark):
    rows = [("a", k, k * 1.0, float(k), 1.0, k % 7 != 0, True, "x") for k in range(0, 1500)]
    got = {r["slot"]: (r["state"], r["value"]) for r in regular_grid(spark.createDataFrame(rows, GRID)).where("field = 'x_m'").collect()}
    assert len(got) == 1500 and got[511] == ("interpolated", 511.5) and got[512] == ("observed", 512.0)
    assert regular_grid(spark.createDataFrame([], GRID)).count() == 0
