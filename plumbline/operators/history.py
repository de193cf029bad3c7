"""History of changing attributes: one version per period in which a value held.

Gaps and islands: a row whose value's hash differs from that of the row before (``lag``; where
hashes agree the values decide) starts an island, a running sum numbers the islands, and the
minimum of an island with the next one's start bounds its version. One partitioning by log,
field and piece serves the removal of repeats, the chains and all windows. Groups of any size
are cut into pieces of time; a piece only needs the last value before it and the first island
after it, which come from one summary row per piece.

Defined results: records with a null value say nothing, records with a null key or time are
dropped, and records with the same ``seq`` count once. Values are compared by
:func:`canonical`. Of several records at one instant the end of their chain of previous and
new values counts; if the chain is a circle, it ends where it began, so it says nothing where
the value before is part of it (where it isn't, or is unknown, the chain is taken in order of
``seq``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from plumbline.operators.changes import numbered
from plumbline.operators.pieces import carried, is_whole, piece_keys, split_hot

KEYS = ["evidence_id", "field"]
TRUE_WORDS, FALSE_WORDS = ("true", "t", "yes", "y", "on"), ("false", "f", "no", "n", "off")
#: Fields whose values are codes; all others are booleans.
CODE_FIELDS = ("arming_state", "nav_state")


def canonical(df: DataFrame, source: str, target: str) -> DataFrame:
    """Adds ``target``, one spelling per value of ``source``: white space, case, signs,
    decimals and words for truth don't matter; text without content is null."""
    df = df.withColumn("_text", F.lower(F.trim(F.regexp_replace(source, r"[\s\x00]+", " "))))
    df = df.withColumn("_number", F.expr("try_cast(_text as double)"))
    word = F.when(F.col("_text").isin(*TRUE_WORDS), "1").when(F.col("_text").isin(*FALSE_WORDS), "0")
    whole = F.when((F.col("_number") == F.floor("_number")) & (F.abs("_number") < 1e15), F.col("_number").cast("bigint").cast("string")).otherwise(F.col("_number").cast("string"))
    truth = F.when(F.col("_number") != 0, "1").when(F.col("_number") == 0, "0")
    value = F.coalesce(word, F.when(F.col("field").isin(*CODE_FIELDS), whole).otherwise(truth), F.col("_text"))
    return df.withColumn(target, F.when(F.col("_text") != "", value)).drop("_text", "_number")


def instants(states: DataFrame, **hot: int) -> DataFrame:
    """``(evidence_id, field, piece, at_us, value, circle, fallback)``: what holds after each
    instant; ``circle`` has the values of a chain that ends where it began."""
    rows = states.select(*KEYS, "seq", "timestamp_seconds", "previous_value", "new_value").where(
        "evidence_id is not null and field is not null and timestamp_seconds is not null and not isnan(timestamp_seconds) and new_value is not null"
    )
    rows = rows.withColumn("at_us", F.round(F.col("timestamp_seconds") * 1e6).cast("bigint"))
    rows = split_hot(rows, KEYS, "at_us", counted=states, **hot).drop("cut", "timestamp_seconds")
    about, at = rows.schema["piece"].metadata, piece_keys(rows, KEYS)
    piece = F.col("piece") if "piece" in at else F.lit(0).alias("piece")
    rows = rows.repartition(*at)
    # stored repeats have all of these in common; so have repeats of one statement
    rows = rows.dropDuplicates([*at, "at_us", "seq"])
    rows = canonical(canonical(rows, "new_value", "new"), "previous_value", "old").where("new is not null")
    chain = rows.groupBy(*at, "at_us").agg(F.sort_array(F.collect_list(F.struct("seq", "old", "new"))).alias("chain"))
    into = F.transform("chain", lambda r: r["new"])
    out_of = F.transform("chain", lambda r: r["old"])
    # the end of the chain is entered once more than it is left
    ends = F.filter(into, lambda v: F.size(F.filter(into, lambda x: x == v)) > F.size(F.filter(out_of, lambda x: x == v)))
    last = F.try_element_at("chain", F.lit(-1))["new"]
    single = F.size("chain") == 1
    end = F.when(single, last).otherwise(F.try_element_at(ends, F.lit(-1)))
    circle = F.when(~single & (F.size(ends) == 0), F.array_distinct(F.concat(into, F.array_compact(out_of))))
    return chain.select(*KEYS, piece, "at_us", end.alias("value"), circle.alias("circle"), last.alias("fallback")).withMetadata("piece", about)


def attribute_history(states: DataFrame, **hot: int) -> DataFrame:
    """``(evidence_id, field, value, version, valid_from_us, valid_to_us)``, one row per
    version; ``valid_to_us`` is -1 where no version follows."""
    rows = instants(states, **hot)
    whole, at = is_whole(rows), piece_keys(rows, KEYS)
    rows = carried(rows, KEYS, "at_us", F.col("value"), "held")
    settled = F.when(F.col("circle").isNull(), F.col("value")).when(F.col("held").isNull() | ~F.array_contains("circle", F.col("held")), F.col("fallback"))
    rows = rows.withColumn("value", settled).where("value is not null").select(*KEYS, "at_us", "value", "piece")
    rows = rows.withColumn("now", F.struct(F.xxhash64("value").alias("hash"), F.col("value").alias("value")))
    rows = carried(rows, KEYS, "at_us", F.col("now"), "before")
    changed = F.col("before").isNull() | (F.col("before.hash") != F.col("now.hash")) | (F.col("before.value") != F.col("value"))
    rows = numbered(rows.withColumn("changed", changed), KEYS, ["at_us"], F.col("changed"), "island")
    # an island that began in an earlier piece has its row there
    islands = rows.groupBy(*at, "island").agg(F.min("at_us").alias("valid_from_us"), F.first("value").alias("value"), F.bool_or("changed").alias("begins")).where("begins")
    inside = Window.partitionBy(*at).orderBy("valid_from_us")
    islands = islands.withColumn("next_us", F.lead("valid_from_us").over(inside))
    if whole:
        islands = islands.withColumn("follow_us", F.lit(None).cast("bigint"))
    else:
        firsts = islands.groupBy(*KEYS, "piece").agg(F.min("valid_from_us").alias("first_us"))
        firsts = firsts.select(*KEYS, "piece", F.lead("first_us").over(Window.partitionBy(*KEYS).orderBy("piece")).alias("follow_us"))
        islands = islands.join(firsts, [*KEYS, "piece"])
    return islands.select(*KEYS, "value", F.col("island").cast("bigint").alias("version"), "valid_from_us", F.coalesce("next_us", "follow_us", F.lit(-1)).alias("valid_to_us"))
