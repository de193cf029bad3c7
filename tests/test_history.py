from __future__ import annotations

from plumbline.operators.history import attribute_history

SCHEMA = "evidence_id string, field string, seq long, timestamp_seconds double, previous_value string, new_value string, piece string"


def versions(spark, rows, **hot):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return sorted((r["evidence_id"], r["field"], r["value"], r["valid_from_us"], r["valid_to_us"], r["version"]) for r in attribute_history(df, **hot).collect())


def test_spellings_repeats_and_nulls(spark):
    rows = [
        ("a", "armed", 1, 1.0, None, "true"), ("a", "armed", 1, 1.0, None, "true"), ("a", "armed", 2, 2.0, None, " 1.0"), ("a", "armed", 3, 3.0, "1", None),
        ("a", "armed", 4, 4.0, "true", "FALSE"), ("a", "nav_state", 5, 1.5, None, "+17"), ("a", "nav_state", 6, 2.5, "17", "17.0"), (None, "armed", 7, 1.0, None, "1"), ("a", "armed", 8, None, None, "1"),
    ]
    assert versions(spark, rows) == [("a", "armed", "0", 4_000_000, -1, 2), ("a", "armed", "1", 1_000_000, 4_000_000, 1), ("a", "nav_state", "17", 1_500_000, -1, 1)]


def test_chain_at_one_instant(spark):
    # 2 -> 4 -> 3 in any order ends in 3; a circle ends where it began
    rows = [("a", "nav_state", 1, 1.0, None, "2"), ("a", "nav_state", 3, 2.0, "2", "4"), ("a", "nav_state", 2, 2.0, "4", "3"), ("a", "nav_state", 4, 3.0, "3", "5"), ("a", "nav_state", 5, 3.0, "5", "3"), ("a", "nav_state", 6, 4.0, "3", "5")]
    assert [v[2:5] for v in versions(spark, rows)] == [("2", 1_000_000, 2_000_000), ("3", 2_000_000, 4_000_000), ("5", 4_000_000, -1)]


def test_cut_groups_give_the_same(spark):
    rows = [("a" if k % 3 else "b", "nav_state", k, float((k * 7919) % 500), None, str((k * 31) % 4) if k % 5 else None) for k in range(500)]
    assert versions(spark, rows) == versions(spark, rows, hot_rows=20, fan=7)


def test_empty(spark):
    assert versions(spark, []) == []
