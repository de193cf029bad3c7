"""Ordered work on groups of any size.

A group (a log, a field of a log) may hold a third of all rows. ``split_hot`` cuts such
groups along their order into pieces of about ``HOT_ROWS`` rows, however many these are;
groups of usual size stay whole, as piece 0. ``sorted_groups`` then gives whole pieces, in
order, to a function on Arrow data, many small ones at a time. No task holds more than one
piece besides one Arrow batch.

Which groups are cut is known from one count per table and keys (:func:`hot_groups`), which
reads the key columns alone and is kept for the session: it decides about the plan only, not
about results, so an old count does no harm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

#: A group of more rows is cut into pieces of about so many.
HOT_ROWS = 200_000
#: Pieces that one level of cuts makes; larger groups are cut again within their pieces.
FAN = 64
#: Up to so many hot groups, their cuts (half a kB each) are broadcast; beyond, they are
#: joined by a shuffle.
BROADCAST_GROUPS = 10_000
#: Mark of a ``piece`` column that is 0 throughout, as no group is hot: nothing can be
#: inherited from other pieces then, and the plan needn't look for it.
WHOLE = {"whole": True}


def hot_groups(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> tuple[int, int]:
    """How many groups have more than ``hot_rows`` rows, and the rows of the largest."""
    spark = df.sparkSession
    rows = df.select(*keys)
    known = spark.__dict__.setdefault("_plumbline_hot", {})
    at = (rows.semanticHash(), hot_rows)
    if at not in known:
        sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
        known[at] = tuple(sizes.agg(F.count(F.lit(1)), F.coalesce(F.max("_n"), F.lit(0))).head())
    return known[at]


def _cuts(rows: DataFrame, keys: list[str], order: str, hot_rows: int, fan: int, few: bool) -> DataFrame:
    """Of each group above ``hot_rows`` the values of ``order`` that cut it into at most
    ``fan`` pieces of similar size. Counts and quantiles are partial aggregates, and only
    rows of such groups take part in the latter."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    sizes = F.broadcast(sizes) if few else sizes
    at = [i / fan for i in range(1, fan)]
    cuts = rows.join(sizes, keys).groupBy(*keys).agg(F.percentile_approx(order, at, 10_000).alias("_q"), F.first("_n").alias("_n"))
    step = F.greatest(F.lit(1), F.floor(F.lit(float(fan) * hot_rows) / F.col("_n"))).cast("int")
    cuts = cuts.select(*keys, F.array_distinct(F.filter("_q", lambda c, i: (i + 1) % step == 0)).alias("_cuts"))
    return F.broadcast(cuts) if few else cuts


def split_hot(df: DataFrame, keys: list[str], order: str, hot_rows: int = HOT_ROWS, fan: int = FAN, counted: DataFrame | None = None) -> DataFrame:
    """Adds ``piece`` (int) and ``cut`` (boolean): the row's group is cut into pieces.

    Rows at one instant stay together. Null keys or orders fall into piece 0. ``counted`` is
    a table with at least the rows of each group that is cheaper to count than ``df``."""
    groups, largest = hot_groups(df if counted is None else counted, keys, hot_rows)
    if not groups:
        return df.withColumns({"piece": F.lit(0), "cut": F.lit(False)}).withMetadata("piece", WHOLE)
    by = list(keys)
    out = df.withColumn("piece", F.lit(0))
    size, level = largest, 0
    while size > hot_rows:
        rows = out.where("cut") if level else out
        cuts = _cuts(rows.select(*by, order), by, order, hot_rows, fan, not level and groups <= BROADCAST_GROUPS)
        out = out.join(cuts, by, "left")
        inner = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col(order))), F.lit(0))
        place = F.when(F.col("_cuts").isNull() | F.col(order).isNull(), 0).otherwise(inner)
        if not level:
            out = out.withColumn("cut", F.col("_cuts").isNotNull())
        out = out.withColumn("piece", (F.col("piece") * fan + place).cast("int")).drop("_cuts")
        by = [*keys, "piece"]
        size, level = -(-size // fan), level + 1
    return out.withMetadata("piece", {"hot": groups})


def is_whole(df: DataFrame) -> bool:
    """Whether no group of the table is cut."""
    return bool(df.schema["piece"].metadata.get("whole"))


def piece_keys(df: DataFrame, keys: list[str]) -> list[str]:
    """The columns that pieces are partitioned by. Where nothing is cut these are the keys
    alone: as a constant, ``piece`` would make the planner shuffle again for each grouping."""
    return list(keys) if is_whole(df) else [*keys, "piece"]


def _changes(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Where a row's keys differ from those of the row before (False for the first row)."""
    out = np.zeros(len(t), bool)
    for k in keys:
        a = t.column(k).combine_chunks()
        if len(a) > 1:
            differ = pc.not_equal(a[1:], a[:-1])
            null = pc.is_null(a).to_numpy(zero_copy_only=False)
            out[1:] |= pc.fill_null(differ, False).to_numpy(zero_copy_only=False) | (null[1:] != null[:-1])
    return out


def sorted_groups(
    df: DataFrame, keys: list[str], order: list[str],
    fn: Callable[[pa.Table, np.ndarray], pa.Table], schema: str,
) -> DataFrame:
    """Applies ``fn(table, group)`` to whole groups in order; ``group`` numbers the groups
    of the table 0, 1, 2, ... One shuffle on the keys and one sort within partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []

        def done(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            t = pa.concat_tables(parts).combine_chunks()
            if len(t):
                yield from fn(t, np.cumsum(_changes(t, keys))).to_batches()

        for b in batches:
            t = pa.Table.from_batches([b])
            if not len(t):
                continue
            joined = pa.concat_tables([waiting[-1].slice(len(waiting[-1]) - 1), t]) if waiting else t
            change = _changes(joined.select(keys), keys)
            cut = np.flatnonzero(change)
            if not len(cut):
                waiting.append(t)
                continue
            at = int(cut[-1]) - (1 if waiting else 0)
            yield from done([*waiting, t.slice(0, at)])
            waiting = [t.slice(at)]
        if waiting:
            yield from done(waiting)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def floats(t: pa.Table, name: str) -> np.ndarray:
    """A numeric column as doubles, nulls as NaN."""
    return t.column(name).cast(pa.float64()).to_numpy()


def _last(c: Column) -> Column:
    return F.last(c, ignorenulls=True)


def carried(df: DataFrame, keys: list[str], order: str | list[str], value: Column, name: str, how: Callable[[Column], Column] = _last) -> DataFrame:
    """Adds ``name``: the last non-null ``value`` of the earlier rows of the group, or with
    ``how`` another running aggregate of them that can be nested: ``F.max``, ``F.min``,
    ``F.sum``. Within a piece by a window; what a piece inherits comes from one summary row
    per piece."""
    order = [order] if isinstance(order, str) else order
    far = Window.unboundedPreceding
    inside = Window.partitionBy(*keys, "piece").orderBy(*order)
    if is_whole(df):
        return df.withColumn("_v", value).withColumn(name, how(F.col("_v")).over(inside.rowsBetween(far, -1))).drop("_v")
    df = df.withColumn("_v", value).withColumn("_in", how(F.col("_v")).over(inside.rowsBetween(far, -1)))
    end = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))) if how is _last else how(F.col("_v"))
    across = Window.partitionBy(*keys).orderBy("piece").rowsBetween(far, -1)
    ends = df.groupBy(*keys, "piece").agg(end.alias("_end")).withColumn("_before", how(F.col("_end")).over(across)).where("_before is not null").drop("_end")
    df = df.join(ends, [*keys, "piece"], "left")
    return df.withColumn(name, _nested(how)).drop("_v", "_in", "_before")


def _nested(how: Callable[[Column], Column]) -> Column:
    if how is _last:
        return F.coalesce("_in", "_before")
    if how is F.max:
        return F.greatest("_in", "_before")
    if how is F.min:
        return F.least("_in", "_before")
    if how is F.sum:
        return F.when(F.col("_in").isNotNull() | F.col("_before").isNotNull(), F.coalesce("_in", F.lit(0)) + F.coalesce("_before", F.lit(0)))
    raise ValueError("only the last value, the maximum, the minimum and the sum can be carried")


def sequenced(df: DataFrame, keys: list[str], order: str, seq: str = "seq", **hot: int) -> DataFrame:
    """Records ready for ordered work: without null keys and orders, each stored once, cut
    into pieces, and partitioned so that windows on keys and piece need no shuffle."""
    rows = df.where(" and ".join(f"{k} is not null" for k in [*keys, order]))
    cut = split_hot(rows, keys, order, **hot).drop("cut")
    at = piece_keys(cut, keys)
    return cut.repartition(*at).dropDuplicates([*at, seq])
