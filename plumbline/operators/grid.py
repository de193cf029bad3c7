"""Irregular readings onto a regular grid of one value per second.

Per log and quantity, the sorted grid is merged with the sorted readings: each grid second
takes its own readings, or its neighbours on both sides and the straight line between them,
weighted by time, if they are at most ``gap_limit`` seconds apart; otherwise it is marked as
missing. The readings are first reduced to one row per second (count, mean, first, last), so
each second has one row from either side however dense the readings are. Grid and merge are
spread over bins of log and time; a bin sees the readings within the gap limit around it.

Defined results: the grid of a log reaches from the second of its first record to that of
its last, valid or not; a reading counts if its value is not null or NaN and its flag is true
(null is not true); records with a null log or time are dropped; stored repeats count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

QUANTITIES = {"x_m": "position_valid", "vx_m_s": "velocity_valid"}
BIN_SLOTS = 512
GAP_LIMIT_S = 10


def regular_grid(readings: DataFrame, quantities: dict[str, str] | None = None, gap_limit: int = GAP_LIMIT_S) -> DataFrame:
    """``(evidence_id, field, slot, value, state)``, state 'observed', 'interpolated' or
    'missing'. ``quantities`` maps each value column to its validity flag."""
    quantities = quantities or QUANTITIES
    rows = readings.select("evidence_id", "seq", "timestamp", *quantities, *dict.fromkeys(quantities.values())).where("evidence_id is not null and timestamp is not null and not isnan(timestamp)")
    rows = rows.withColumn("slot", F.floor("timestamp").cast("bigint"))
    # stored repeats must not weigh on the mean; one shuffle serves this and the reduction
    per: dict[str, list] = {}
    for q, flag in quantities.items():
        good = F.col(flag) & F.col(q).isNotNull() & ~F.isnan(q)
        point = F.when(good, F.struct(F.col("timestamp").alias("t"), F.col("seq").alias("s"), F.col(q).alias("v")))
        per[q] = [F.min(point).alias(f"{q}_first"), F.max(point).alias(f"{q}_last"), F.avg(F.when(good, F.col(q))).alias(f"{q}_mean")]
    seconds = rows.repartition("evidence_id", "slot").dropDuplicates(["evidence_id", "slot", "seq"]).groupBy("evidence_id", "slot").agg(*[a for x in per.values() for a in x])

    span = rows.groupBy("evidence_id").agg(F.min("slot").alias("low"), F.max("slot").alias("high"))
    size = F.lit(BIN_SLOTS)
    bins = span.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") / size), F.floor(F.col("high") / size))))
    # from here on a long log is many rows, of which each yields one bin's seconds
    grid = bins.repartition("evidence_id", "bin").select(
        "evidence_id", "bin", F.explode(F.sequence(F.greatest("low", F.col("bin") * size), F.least("high", F.col("bin") * size + (BIN_SLOTS - 1)))).alias("slot")
    )
    around = F.sequence(F.floor((F.col("slot") - gap_limit) / size), F.floor((F.col("slot") + gap_limit) / size))
    seen = seconds.withColumn("bin", F.explode(around))
    both = seen.unionByName(grid.withColumn("asked", F.lit(True)), allowMissingColumns=True).repartition("evidence_id", "bin")
    merged = both.groupBy("evidence_id", "bin", "slot").agg(*[F.max(c).alias(c) for c in both.columns if c not in ("evidence_id", "bin", "slot")])
    forward = Window.partitionBy("evidence_id", "bin").orderBy("slot")
    backward = Window.partitionBy("evidence_id", "bin").orderBy(F.col("slot").desc())
    far = Window.unboundedPreceding
    for q in quantities:
        merged = merged.withColumn(f"{q}_left", F.last(f"{q}_last", ignorenulls=True).over(forward.rowsBetween(far, -1)))
    for q in quantities:
        merged = merged.withColumn(f"{q}_right", F.last(f"{q}_first", ignorenulls=True).over(backward.rowsBetween(far, -1)))
    series = []
    for q in quantities:
        own, left, right, at = F.col(f"{q}_mean"), F.col(f"{q}_left"), F.col(f"{q}_right"), F.col("slot") + 0.5
        between = own.isNull() & (right["t"] - left["t"] <= gap_limit)
        value = F.when(own.isNotNull(), own).when(between, left["v"] + (right["v"] - left["v"]) * (at - left["t"]) / (right["t"] - left["t"]))
        state = F.when(own.isNotNull(), "observed").when(between, "interpolated").otherwise("missing")
        series.append(F.struct(F.lit(q).alias("field"), value.alias("value"), state.alias("state")))
    return merged.where("asked").select("evidence_id", "slot", F.explode(F.array(*series)).alias("s")).select("evidence_id", "s.field", "slot", "s.value", "s.state")
