"""Changes, intervals and segments in ordered records.

All functions take rows from :func:`plumbline.operators.pieces.sequenced` (each record once,
cut into pieces) and keep groups of any size in pieces. Ties in the order are settled by
``seq``. Empty tables give empty results; nulls are treated as each policy says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.operators.pieces import carried

#: How a change sees nulls. ``skip``: nulls are left out. ``value``: null is a value.
#: ``held``: the row before must have a value, this one may be null. ``both``: this row and
#: the one before must both have values.
POLICIES = ("skip", "value", "held", "both")


def with_previous(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, Column]) -> DataFrame:
    """Adds ``prev``, a struct of the given columns of the row before (null for the first)."""
    return carried(df, keys, order, F.struct(*[c.alias(n) for n, c in columns.items()]), "prev")


def changes(df: DataFrame, keys: list[str], order: list[str], value: str, policy: str = "skip") -> DataFrame:
    """Rows at which ``value`` changes, with ``previous_value``."""
    if policy not in POLICIES:
        raise ValueError(f"policy is one of {POLICIES}")
    rows = df.where(F.col(value).isNotNull()) if policy == "skip" else df
    rows = with_previous(rows, keys, order, {"value": F.col(value)})
    now, before = F.col(value), F.col("prev.value")
    changed = F.col("prev").isNotNull() & ~now.eqNullSafe(before)
    if policy == "held":
        changed &= before.isNotNull()
    if policy == "both":
        changed &= before.isNotNull() & now.isNotNull()
    return rows.where(changed).withColumn("previous_value", before).drop("prev")


def numbered(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str) -> DataFrame:
    """Adds ``name``: how many rows up to and including this one start something."""
    df = df.withColumn("_starts", F.coalesce(starts.cast("int"), F.lit(0)))
    df = carried(df, keys, order, F.col("_starts"), "_count", F.sum)
    return df.withColumn(name, F.coalesce("_count", F.lit(0)) + F.col("_starts")).drop("_starts", "_count")


def edges(df: DataFrame, keys: list[str], order: list[str], flag: str) -> DataFrame:
    """Assertions and clearings of a three-valued flag: nulls are carried over, and the first
    observation is where things start from, not an event."""
    return changes(df, keys, order, flag, "skip").withColumn("edge", F.when(F.col(flag), "ASSERTED").otherwise("CLEARED"))


def flag_intervals(df: DataFrame, keys: list[str], order: list[str], flag: str, time: str) -> DataFrame:
    """Periods in which a three-valued flag was true. Nulls neither open nor close one.

    ``start`` is the first true; ``last_true`` the last one if there were two or more, else
    null; ``end`` is the time of the false that closed it, else the last true; ``open`` tells
    that nothing closed it; ``first_seq`` is the record that opened it."""
    rows = df.where(F.col(flag).isNotNull())
    rows = with_previous(rows, keys, order, {"flag": F.col(flag)})
    begins = F.col(flag) & (F.col("prev").isNull() | ~F.col("prev.flag"))
    rows = numbered(rows, keys, order, begins, "interval").where("interval > 0")
    # after a false, further falses belong to no interval
    rows = rows.where(F.col(flag) | F.col("prev.flag"))
    true_time = F.when(F.col(flag), F.col(time))
    out = rows.groupBy(*keys, "interval").agg(
        F.min_by("seq", F.when(F.col(flag), F.struct(*order))).alias("first_seq"), F.min(true_time).alias("start"), F.max(true_time).alias("_last"), F.count_if(flag).alias("samples"), F.min(F.when(~F.col(flag), F.col(time))).alias("_closed")
    )
    return out.select(
        *keys, "interval", "start", F.when(F.col("samples") > 1, F.col("_last")).alias("last_true"), F.coalesce("_closed", "_last").alias("end"),
        F.col("_closed").isNull().alias("open"), "samples", "first_seq",
    )


def segmented(df: DataFrame, keys: list[str], order: list[str], valid: str, counters: list[str]) -> DataFrame:
    """Adds ``segment``: a new one starts where the record before was invalid or where a reset
    counter differs from its last known value."""
    rows = with_previous(df, keys, order, {"valid": F.coalesce(valid, F.lit(False))})
    begins = F.col("prev").isNotNull() & ~F.col("prev.valid")
    for c in counters:
        rows = carried(rows, keys, order, F.col(c), f"_last_{c}")
        begins |= F.coalesce(F.col(c) != F.col(f"_last_{c}"), F.lit(False))
    return numbered(rows, keys, order, begins, "segment").drop("prev", *[f"_last_{c}" for c in counters])


def chunked(df: DataFrame, keys: list[str], order: list[str], time: str, valid: str, max_gap: float) -> DataFrame:
    """Adds ``chunk`` to valid records: continuous stretches, broken by an invalid record, by
    time that doesn't advance, by more than ``max_gap`` seconds and by a new segment."""
    rows = with_previous(df, keys, order, {"t": F.col(time), "valid": F.coalesce(valid, F.lit(False)), "segment": F.col("segment")})
    dt = F.col(time) - F.col("prev.t")
    begins = F.col("prev").isNull() | ~F.col("prev.valid") | ~F.coalesce(valid, F.lit(False)) | (dt <= 0) | (dt > max_gap) | (F.col("segment") != F.col("prev.segment"))
    return numbered(rows, keys, order, begins, "chunk").where(valid).drop("prev")


def overlaps(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Records that begin before an earlier one of their group has ended."""
    rows = carried(df, keys, [start, "seq"], F.col(end), "latest_end", F.max)
    return rows.where(F.col(start) < F.col("latest_end"))


def burst_counts(df: DataFrame, keys: list[str], time: str, windows: dict[str, int], flags: dict[str, Column]) -> DataFrame:
    """For each record and window the number of other records of its group at most so many
    units of time away, and of those with each flag. Range frames count without a join, so no
    pair is formed. Time is cut into bins with the widest window as margin, which spreads hot
    groups; rows at one instant stay together."""
    widest = max(windows.values())
    width = 16 * widest
    rows = df.withColumn("_home", F.floor(F.col(time) / F.lit(width)))
    rows = rows.withColumn("_bin", F.explode(F.sequence(F.floor((F.col(time) - widest) / F.lit(width)), F.floor((F.col(time) + widest) / F.lit(width)))))
    line = Window.partitionBy(*keys, "_bin").orderBy(time)
    for name, c in flags.items():
        rows = rows.withColumn(f"_is_{name}", c.cast("int"))
    for w, span in windows.items():
        frame = line.rangeBetween(-span, span)
        rows = rows.withColumn(f"{w}_nearby", F.count(F.lit(1)).over(frame) - 1)
        for name in flags:
            rows = rows.withColumn(f"{w}_{name}", F.coalesce(F.sum(f"_is_{name}").over(frame), F.lit(0)))
    return rows.where(F.col("_home") == F.col("_bin")).drop("_home", "_bin", *[f"_is_{n}" for n in flags])
