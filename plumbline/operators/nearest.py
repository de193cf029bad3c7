"""Nearest match in time, within a tolerance.

Each right-hand record owns the interval of times to which it is the nearest: from the
midpoint with its predecessor to the midpoint with its successor, cut at the tolerance. The
intervals of one key don't overlap, so a left-hand time lies in at most one of them and the
range join emits no pair that is dropped later. The intervals are indexed by time bins: a
bin holds the right-hand records in it and within the tolerance around it, which are all
that its left-hand times can be matched with, so key and bin are the join key and a hot key
is spread over its bins. All times are whole microseconds; nothing is rounded.

Defined results: null keys and null times match nothing; records with the same sequence
number count once; of right-hand records at one instant, and of two at the same distance, the
smaller sequence number wins; several left-hand records may have one match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def micros(seconds: Column) -> Column:
    return F.round(seconds * 1e6).cast("bigint")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], tolerance_us: int, bin_us: int | None = None) -> DataFrame:
    """``(left_seq, right_seq, delta_us)`` for left and right with ``keys``, ``seq`` and
    ``at_us``; ``delta_us`` is right minus left. ``bin_us``, at least twice the tolerance,
    trades copies of right-hand records against rows per bin."""
    tol = int(tolerance_us)
    width = max(int(bin_us or 0), 2 * tol, 1)

    def bin_of(t: Column) -> Column:
        return F.floor(t / F.lit(width)).cast("bigint")

    present = " and ".join(f"{k} is not null" for k in [*keys, "at_us", "seq"])
    # one row per instant; this also takes out stored repeats, before the shuffle
    r = right.select(*keys, "at_us", "seq").where(present).groupBy(*keys, "at_us").agg(F.min("seq").alias("right_seq"))
    r = r.withColumn("bin", F.explode(F.sequence(bin_of(F.col("at_us") - tol), bin_of(F.col("at_us") + tol))))
    near = Window.partitionBy(*keys, "bin").orderBy("at_us")
    before_t, before_s = F.lag("at_us").over(near), F.lag("right_seq").over(near)
    after_t, after_s = F.lead("at_us").over(near), F.lead("right_seq").over(near)
    # in half microseconds: 2 * left >= previous + own; the midpoint belongs to the smaller number
    low = F.when(before_s < F.col("right_seq"), before_t + F.col("at_us") + 1).otherwise(before_t + F.col("at_us"))
    high = F.when(after_s < F.col("right_seq"), after_t + F.col("at_us") - 1).otherwise(after_t + F.col("at_us"))
    r = r.withColumns({
        "low2": F.greatest(2 * (F.col("at_us") - tol), low), "high2": F.least(2 * (F.col("at_us") + tol), high),
    }).withColumnRenamed("at_us", "right_us")
    l = left.select(*keys, F.col("at_us").alias("left_us"), F.col("seq").alias("left_seq")).where(" and ".join(f"{k} is not null" for k in [*keys, "left_us", "left_seq"])).dropDuplicates([*keys, "left_us", "left_seq"])
    l = l.withColumn("bin", bin_of(F.col("left_us"))).withColumn("left2", 2 * F.col("left_us"))
    # other names on the right, so that tables of one origin can be joined
    r = r.withColumnsRenamed({k: f"_r_{k}" for k in [*keys, "bin"]})
    on = F.col("left2").between(F.col("low2"), F.col("high2"))
    for k in [*keys, "bin"]:
        on &= F.col(k) == F.col(f"_r_{k}")
    return l.join(r, on).select("left_seq", "right_seq", (F.col("right_us") - F.col("left_us")).alias("delta_us"), *keys)


COMMAND_TOLERANCE_US, FRAME_TOLERANCE_US = 2_000_000, 1_000_000


def command_acks(commands: DataFrame, acks: DataFrame, tolerance_us: int = COMMAND_TOLERANCE_US) -> DataFrame:
    """Each command with the nearest acknowledgement of its id in its log."""
    return nearest(
        commands.withColumn("at_us", F.col("command_timestamp_us")), acks.withColumn("at_us", F.col("timestamp_us")), ["evidence_id", "command_id"], tolerance_us
    )


def frame_pings(frames: DataFrame, gps: DataFrame, tolerance_us: int = FRAME_TOLERANCE_US) -> DataFrame:
    """Each video frame with the nearest position record of its log."""
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    return nearest(
        frames.withColumn("at_us", micros(clean("log_offset_s") + clean("start_s"))), gps.withColumn("at_us", micros(clean("timestamp"))), ["evidence_id"], tolerance_us
    )
