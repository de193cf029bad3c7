from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators.pieces import carried, hot_groups, is_whole, piece_keys, sequenced, split_hot

SCHEMA = "evidence_id string, seq long, timestamp double, v int"


def rows(spark, n=5000):
    one = [("hot", k, float((k * 7919) % n), k % 5 or None) for k in range(n)]
    return spark.createDataFrame([*one, *[("cold", 10_000 + k, float(k), k) for k in range(30)], (None, 99_999, 1.0, 1), ("hot", 88_888, None, 1)], SCHEMA)


def test_pieces_stay_small_however_large_the_group(spark):
    df = rows(spark)
    assert hot_groups(df, ["evidence_id"], 60) == (1, 5001) and hot_groups(df, ["evidence_id"], 10_000) == (0, 0)
    cut = split_hot(df, ["evidence_id"], "timestamp", hot_rows=60, fan=4)
    assert not is_whole(cut) and piece_keys(cut, ["evidence_id"]) == ["evidence_id", "piece"] and cut.count() == df.count()
    per = {(r["evidence_id"], r["piece"]): r for r in cut.where("timestamp is not null").groupBy("evidence_id", "piece").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b"), F.bool_or("cut").alias("cut")).collect()}
    hot = [per[k] for k in sorted(k for k in per if k[0] == "hot")]
    assert len(hot) > 60 and max(r["n"] for r in hot) <= 120 and all(x["b"] < y["a"] for x, y in zip(hot, hot[1:], strict=False)) and all(r["cut"] for r in hot)
    assert per["cold", 0]["n"] == 30 and not per["cold", 0]["cut"]
    whole = split_hot(df, ["evidence_id"], "timestamp")
    assert is_whole(whole) and piece_keys(whole, ["evidence_id"]) == ["evidence_id"]


def test_running_values_cross_pieces(spark):
    df = rows(spark, 900)

    def run(**hot):
        r = sequenced(df, ["evidence_id"], "timestamp", **hot)
        for name, how in (("last", None), ("most", F.max), ("sum", F.sum)):
            r = carried(r, ["evidence_id"], ["timestamp", "seq"], F.col("v"), name, **({} if how is None else {"how": how}))
        return sorted((x["evidence_id"], x["seq"], x["last"], x["most"], x["sum"]) for x in r.collect())

    assert run() == run(hot_rows=50, fan=3) and len(run()) == 930


def test_one_shuffle_where_nothing_is_cut(spark):
    r = carried(sequenced(rows(spark), ["evidence_id"], "timestamp"), ["evidence_id"], ["timestamp", "seq"], F.col("v"), "last")
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
