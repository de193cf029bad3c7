"""Commands and acknowledgements: windows, as-of joins and what has no counterpart.

Band joins meet in time bins as wide as the band, so key and bin are the join key and a hot
key is spread over its bins; only pairs within the band are formed. As-of joins sort both
sides together and carry the last record along, without pairs. All records count once; null
ids match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.operators.pieces import carried, split_hot

ACK_WINDOW_US = 5_000_000


def band_pairs(left: DataFrame, right: DataFrame, keys: list[str], low: int, high: int) -> DataFrame:
    """All pairs with equal keys and ``low <= right.at_us - left.at_us <= high``. The left has
    ``at_us``, ``left_*``, the right ``at_us``, ``right_*`` columns besides the keys."""
    width = max(high - low, 1)
    l = left.withColumnRenamed("at_us", "left_us")
    l = l.withColumn("_bin", F.explode(F.sequence(F.floor((F.col("left_us") + low) / F.lit(width)), F.floor((F.col("left_us") + high) / F.lit(width)))))
    r = right.withColumnRenamed("at_us", "right_us").withColumn("_bin", F.floor(F.col("right_us") / F.lit(width)))
    # other names on the right, so that tables of one origin can be joined
    r = r.withColumnsRenamed({k: f"_r_{k}" for k in [*keys, "_bin"]})
    on = (F.col("right_us") - F.col("left_us")).between(low, high)
    for k in [*keys, "_bin"]:
        on &= F.col(k) == F.col(f"_r_{k}")
    return l.join(r, on).drop("_bin", *[f"_r_{k}" for k in [*keys, "_bin"]])


def sides(commands: DataFrame, acks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables once per record, with the names that the joins use."""
    c = commands.select("evidence_id", F.col("seq").alias("left_seq"), F.col("command_timestamp_us").alias("at_us"), "command_id")
    a = acks.select("evidence_id", F.col("seq").alias("right_seq"), F.col("timestamp_us").alias("at_us"), "command_id", "result")
    return c.where("evidence_id is not null and at_us is not null").dropDuplicates(["left_seq"]), a.where("evidence_id is not null and at_us is not null").dropDuplicates(["right_seq"])


def exact_pairs(commands: DataFrame, acks: DataFrame, window_us: int = ACK_WINDOW_US) -> DataFrame:
    """Every command with every acknowledgement of its id within the window, either way."""
    c, a = sides(commands, acks)
    return band_pairs(c, a, ["evidence_id", "command_id"], -window_us, window_us)


def mismatches(lone: DataFrame, acks: DataFrame, window_us: int = ACK_WINDOW_US) -> DataFrame:
    """Commands that have no acknowledgement of their id, each with every one of another id
    within the window; both as :func:`sides` gives them."""
    other = acks.withColumnsRenamed({"command_id": "ack_id"}).where("ack_id is not null")
    return band_pairs(lone, other, ["evidence_id"], -window_us, window_us).where(F.col("ack_id") != F.col("command_id"))


def mismatched_pairs(commands: DataFrame, acks: DataFrame, window_us: int = ACK_WINDOW_US) -> DataFrame:
    """:func:`mismatches` of whole tables."""
    c, a = sides(commands, acks)
    matched = band_pairs(c, a, ["evidence_id", "command_id"], -window_us, window_us).select("left_seq").distinct()
    return mismatches(c.where("command_id is not null").join(matched, "left_seq", "left_anti"), a, window_us)


def repeated(commands: DataFrame) -> DataFrame:
    """Ids that a log commands more than once, with the first and last time; ``commands`` as
    :func:`sides` gives them."""
    per = commands.where("command_id is not null").groupBy("evidence_id", "command_id")
    return per.agg(F.count(F.lit(1)).alias("commands"), F.min("at_us").alias("first_us"), F.max("at_us").alias("last_us"), F.min("left_seq").alias("least_seq")).where("commands > 1")


def commands_without_ack(commands: DataFrame, acks: DataFrame, window_us: int = ACK_WINDOW_US) -> DataFrame:
    """Commands with no acknowledgement of their id in the window, with the nearest one of
    another id there and how many of those there are. A command without id asks for none."""
    c, a = sides(commands, acks)
    c = c.where("command_id is not null")
    matched = band_pairs(c, a, ["evidence_id", "command_id"], -window_us, window_us).select("left_seq").distinct()
    lone = c.join(matched, "left_seq", "left_anti")
    near = mismatches(lone, a, window_us)
    gap = F.abs(F.col("right_us") - F.col("left_us"))
    best = near.groupBy("left_seq").agg(F.min_by(F.struct("right_seq", "ack_id", "right_us"), F.struct(gap, F.col("right_seq"))).alias("b"), F.count(F.lit(1)).alias("candidates"))
    out = lone.join(best, "left_seq", "left")
    return out.select(
        "evidence_id", F.col("left_seq").alias("command_seq"), "command_id", F.col("at_us").alias("command_us"), F.col("b.right_seq").alias("nearest_ack_seq"), F.col("b.ack_id").alias("nearest_ack_id"),
        (F.col("b.right_us") - F.col("at_us")).alias("delta_us"), F.coalesce("candidates", F.lit(0)).alias("candidates"),
    )


def acks_without_command(commands: DataFrame, acks: DataFrame, window_us: int = ACK_WINDOW_US) -> DataFrame:
    """Acknowledgements with an id that no command of that id in the window explains, nor a
    command there whose own id nobody acknowledged: to that one they are a mismatch. A
    command without id makes no mismatch."""
    c, a = sides(commands, acks)
    exact = band_pairs(c, a, ["evidence_id", "command_id"], -window_us, window_us)
    lone = c.where("command_id is not null").join(exact.select("left_seq").distinct(), "left_seq", "left_anti")
    used = exact.select("right_seq").unionByName(mismatches(lone, a, window_us).select("right_seq")).distinct()
    return a.where("command_id is not null").join(used, "right_seq", "left_anti").select("evidence_id", F.col("right_seq").alias("ack_seq"), "command_id", "at_us")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], value: Column, name: str, direction: str = "backward", counted: DataFrame | None = None, **hot: int) -> DataFrame:
    """Each left record with ``value`` of the last right record at or before it ('backward'),
    or of the first at or after it ('forward'). Both sides have ``at_us`` and ``seq``; of
    right records at one instant the smaller ``seq`` is taken. Null keys match nothing.
    ``counted`` has at least the rows of both sides, as :func:`split_hot` wants it."""
    if direction not in ("backward", "forward"):
        raise ValueError("direction is 'backward' or 'forward'")
    sign = 1 if direction == "backward" else -1
    r = right.where(" and ".join(f"{k} is not null" for k in [*keys, "at_us"])).groupBy(*keys, "at_us").agg(F.min_by(value, "seq").alias("_value"))
    r = r.withColumn("_side", F.lit(0))
    whole = F.lit(True)
    for k in [*keys, "at_us"]:
        whole &= F.col(k).isNotNull()
    l = left.withColumn("_side", F.lit(1))
    both = l.where(whole).unionByName(r, allowMissingColumns=True).withColumn("_at", sign * F.col("at_us"))
    counted = left.select(*keys).unionByName(right.select(*keys)) if counted is None else counted
    both = split_hot(both, keys, "_at", counted=counted, **hot).drop("cut")
    both = carried(both, keys, ["_at", "_side"], F.col("_value"), name).where("_side = 1").drop("_side", "_at", "_value", "piece")
    lost = l.where(~F.coalesce(whole, F.lit(False))).drop("_side")
    return both.unionByName(lost, allowMissingColumns=True)


def following_ack(commands: DataFrame, acks: DataFrame, window_us: int = ACK_WINDOW_US) -> DataFrame:
    """Each command with the earliest acknowledgement of its id that follows within the
    window; commands without one stay."""
    c, a = sides(commands, acks)
    keys = ["evidence_id", "command_id"]
    found = as_of(c.withColumnRenamed("left_seq", "seq"), a.withColumnRenamed("right_seq", "seq"), keys, F.struct("seq", "at_us", "result"), "ack", "forward", commands.select(*keys).unionByName(acks.select(*keys)))
    ok = F.col("ack.at_us") - F.col("at_us") <= window_us
    return found.select(
        "evidence_id", F.col("seq").alias("command_seq"), "command_id", F.when(ok, F.col("ack.seq")).alias("ack_seq"), F.when(ok, F.col("ack.result")).alias("ack_result"),
        F.when(ok, F.col("ack.at_us") - F.col("at_us")).alias("delta_us"),
    )


def closest_ack(commands: DataFrame, acks: DataFrame) -> DataFrame:
    """Each command with the closest acknowledgement of its id however far, and how many
    there are in its log. Two as-of joins; candidates are counted, not listed."""
    c, a = sides(commands, acks)
    keys = ["evidence_id", "command_id"]
    value = F.struct("seq", "at_us")
    r = a.withColumnRenamed("right_seq", "seq")
    raw = commands.select(*keys).unionByName(acks.select(*keys))
    x = as_of(as_of(c.withColumnRenamed("left_seq", "seq"), r, keys, value, "before", counted=raw), r, keys, value, "after", "forward", raw)
    x = x.join(a.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, "left")
    back, on = F.col("at_us") - F.col("before.at_us"), F.col("after.at_us") - F.col("at_us")
    first = F.col("after").isNull() | (back < on) | ((back == on) & (F.col("before.seq") < F.col("after.seq")))
    best = F.when(F.col("before").isNotNull() & first, F.col("before")).otherwise(F.col("after"))
    return x.select("evidence_id", F.col("seq").alias("command_seq"), "command_id", best["seq"].alias("ack_seq"), (best["at_us"] - F.col("at_us")).alias("delta_us"), F.coalesce("n", F.lit(0)).alias("candidates"))
