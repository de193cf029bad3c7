"""Trajectories: usable samples with velocities, their regular grid, histories and sources.

Samples are taken in order of time. A record is usable if its position is valid and complete; a
new segment starts after one that isn't, and where the reset counter changes. Velocities are
the reported ones, else backward differences within the segment and across no gap. Chunks are
stretches of usable samples without a gap, a repeated time or a new segment. All of it needs
the row before only, so groups of any size are cut into pieces.

The grid of a chunk starts with its first sample. Observations on it are held from the latest
sample, so nothing later leaks into them; targets are interpolated. Each sample gives the grid
points since the one before, so no series is gathered.

Defined results: records without log or time are dropped, stored repeats count once, chunks of
one sample have a grid of one point; null and NaN velocities are derived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions import geo
from plumbline.functions.numbers import finite
from plumbline.operators.changes import numbered, segmented, with_previous
from plumbline.operators.pieces import carried, sequenced

LOG, TIME = ["evidence_id"], ["timestamp", "seq"]
AXES = ("x_m", "y_m", "z_m")
VELOCITIES = ("vx_m_s", "vy_m_s", "vz_m_s")
#: Samples closer than this are no gap, however dense the others are.
LEAST_GAP_S = 0.25
#: Horizontal speed from which a course is reliable.
RELIABLE_M_S = 0.1


def max_gap(interval_s: float) -> float:
    """The longest step within a chunk of a grid."""
    return max(2.5 * interval_s, LEAST_GAP_S)


def micros(seconds: Column) -> Column:
    return F.round(seconds * 1e6).cast("bigint")


def with_velocity(rows: DataFrame) -> DataFrame:
    """Rows of usable samples in pieces, with ``segment``: missing velocities are differences
    from the row before, zero across segments and gaps; the gap follows the smallest step that
    the log has had so far."""
    before = {"timestamp": F.col("timestamp"), "segment": F.col("segment"), **{a: F.col(a) for a in AXES}}
    rows = with_previous(rows, LOG, TIME, before)
    rows = rows.withColumn("_dt", F.col("timestamp") - F.col("prev.timestamp"))
    positive = F.when(F.col("_dt") > 0, F.col("_dt"))
    rows = carried(rows, LOG, TIME, positive, "_least", F.min)
    near = (F.col("_dt") > 0) & (F.col("_dt") <= F.greatest(F.lit(LEAST_GAP_S), 2.5 * F.least("_least", positive))) & (F.col("segment") == F.col("prev.segment"))
    given = F.coalesce(F.col("velocity_valid"), F.lit(False))
    for v in VELOCITIES:
        given &= finite(F.col(v)).isNotNull()
    derived = {v: F.when(near, (F.col(a) - F.col(f"prev.{a}")) / F.col("_dt")).otherwise(0.0) for a, v in zip(AXES, VELOCITIES, strict=True)}
    return rows.withColumns({v: F.when(given, F.col(v)).otherwise(d) for v, d in derived.items()}).drop("prev", "_dt", "_least")


def samples(trajectory: DataFrame, interval_s: float = 1.0, **hot: int) -> DataFrame:
    """``(evidence_id, seq, timestamp, at_us, axes, velocities, segment, chunk, start_us,
    prev)`` of the usable samples; ``prev`` is the sample before in the chunk, null for its
    first, ``start_us`` the time of the latter."""
    columns = [*AXES, *VELOCITIES, "position_valid", "velocity_valid", "vertical_reset_counter"]
    rows = sequenced(trajectory.select("evidence_id", "seq", "timestamp", *columns).where("not isnan(timestamp)"), LOG, "timestamp", **hot)
    usable = F.coalesce("position_valid", F.lit(False))
    for a in AXES:
        usable &= finite(F.col(a)).isNotNull()
    rows = segmented(rows.withColumn("usable", usable), LOG, TIME, F.col("usable"), ["vertical_reset_counter"])
    rows = with_velocity(rows.where("usable")).withColumn("at_us", micros(F.col("timestamp")))
    state = ("timestamp", "at_us", "segment", *AXES, *VELOCITIES)
    rows = with_previous(rows, LOG, TIME, {c: F.col(c) for c in state})
    dt = F.col("timestamp") - F.col("prev.timestamp")
    begins = F.col("prev").isNull() | ~((dt > 0) & (dt <= max_gap(interval_s)) & (F.col("segment") == F.col("prev.segment")))
    rows = numbered(rows.withColumn("begins", begins), LOG, TIME, F.col("begins"), "chunk")
    rows = carried(rows, LOG, TIME, F.when(F.col("begins"), F.col("at_us")), "_start")
    start = F.when(F.col("begins"), F.col("at_us")).otherwise(F.col("_start"))
    return rows.select(
        "evidence_id", "seq", "timestamp", "at_us", *AXES, *VELOCITIES, F.col("segment").cast("bigint").alias("segment"), F.col("chunk").cast("bigint").alias("chunk"), start.alias("start_us"),
        F.when(~F.col("begins"), F.col("prev")).alias("prev"),
    )


def features(rows: DataFrame) -> DataFrame:
    """Adds speed and the sine and cosine of the course (0 where there is none)."""
    x, y, z = (F.col(v) for v in VELOCITIES)
    course = F.atan2(y, x)
    return rows.withColumns({"speed_m_s": F.sqrt(x * x + y * y + z * z), "heading_sin": F.sin(course), "heading_cos": F.cos(course)})


def on_grid(rows: DataFrame, interval_us: int) -> DataFrame:
    """``(evidence_id, chunk, k, at_us, axes, velocities, target_*)``: the state held at each
    point of a chunk's grid and the interpolated position there, of :func:`samples`."""
    since = lambda c: F.floor((c - F.col("start_us")) / F.lit(interval_us)).cast("bigint")
    first = F.col("prev").isNull()
    points = F.when(first, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.filter(F.sequence(since(F.col("prev.at_us")), since(F.col("at_us"))), lambda k: k * interval_us + F.col("start_us") > F.col("prev.at_us"))
    )
    rows = rows.select("*", F.explode(points).alias("k")).withColumn("grid_us", F.col("start_us") + F.col("k") * interval_us)
    own = F.col("prev").isNull() | (F.col("grid_us") == F.col("at_us"))
    weight = (F.col("grid_us") - F.col("prev.at_us")) / (F.col("at_us") - F.col("prev.at_us"))
    held = [F.when(own, F.col(c)).otherwise(F.col(f"prev.{c}")).alias(c) for c in (*AXES, *VELOCITIES)]
    target = [F.when(own, F.col(a)).otherwise(F.col(f"prev.{a}") + (F.col(a) - F.col(f"prev.{a}")) * weight).alias(f"target_{a}") for a in AXES]
    return rows.select("evidence_id", "chunk", "k", F.col("grid_us").alias("at_us"), *held, *target)


def latest_history(rows: DataFrame, trajectory: DataFrame, steps: int, interval_us: int, cutoff_s: float | None = None) -> DataFrame:
    """``(evidence_id, step, at_us, axes, velocities)``: the last ``steps`` grid points of each
    log, counted back from its last record up to the cutoff, with the state held there; ``step``
    0 is the last. Logs whose last record is unusable, or whose last chunk is too short, have
    none. ``rows`` are :func:`samples` of the records up to the cutoff, ``trajectory`` the
    table."""
    upto = trajectory.where("evidence_id is not null and timestamp is not null and not isnan(timestamp)")
    upto = upto if cutoff_s is None else upto.where(F.col("timestamp") <= cutoff_s)
    last = upto.groupBy("evidence_id").agg(micros(F.max("timestamp")).alias("last_us"), F.max_by("seq", F.struct("timestamp", "seq")).alias("last_seq"))
    # one row per log: the chunk that its last record belongs to
    of = rows.join(last, (rows.evidence_id == last.evidence_id) & (rows.seq == last.last_seq), "left_semi").select("evidence_id", F.col("chunk").alias("_chunk"), F.col("start_us").alias("_start"), F.col("at_us").alias("_last"))
    of = of.where(F.col("_last") - (steps - 1) * interval_us >= F.col("_start"))
    near = rows.join(of, "evidence_id").where((F.col("chunk") == F.col("_chunk")))
    back = lambda c: (F.col("_last") - c) / F.lit(interval_us)
    low = F.ceil(back(F.col("at_us"))).cast("bigint")
    high = F.when(F.col("prev").isNull(), low).otherwise(F.ceil(back(F.col("prev.at_us"))).cast("bigint") - 1)
    near = near.where(low < steps).select("*", F.explode(F.when(low <= high, F.sequence(low, F.least(high, F.lit(steps - 1))))).alias("step")).withColumn("grid_us", F.col("_last") - F.col("step") * interval_us)
    own = F.col("grid_us") == F.col("at_us")
    near = near.where((F.col("step") < steps) & (own | F.col("prev").isNotNull()))
    held = [F.when(own, F.col(c)).otherwise(F.col(f"prev.{c}")).alias(c) for c in (*AXES, *VELOCITIES)]
    return near.select("evidence_id", F.col("step").cast("int").alias("step"), F.col("grid_us").alias("at_us"), *held)


def positions(trajectory: DataFrame, gps: DataFrame) -> DataFrame:
    """``(evidence_id, source, seq, at_us, axes)``: of each log its own trajectory if it has a
    usable sample at all, else the plane at the first valid fix of its receiver, with heights
    above that one."""
    native = trajectory.where("evidence_id is not null and timestamp is not null and not isnan(timestamp) and position_valid")
    for a in AXES:
        native = native.where(finite(F.col(a)).isNotNull())
    own = native.select("evidence_id", F.lit("native").alias("source"), "seq", micros(F.col("timestamp")).alias("at_us"), *AXES).dropDuplicates(["seq"])
    valid = geo.valid_fix(F.col("latitude"), F.col("longitude"), F.col("fix_type")) & finite(F.col("altitude_m")).isNotNull()
    fixes = gps.where("evidence_id is not null and timestamp is not null and not isnan(timestamp)").where(valid)
    fixes = fixes.join(native.select("evidence_id").distinct(), "evidence_id", "left_anti").select("evidence_id", "seq", "timestamp", "latitude", "longitude", "altitude_m").dropDuplicates(["seq"])
    origin = fixes.groupBy("evidence_id").agg(F.min_by(F.struct("latitude", "longitude", "altitude_m"), F.struct("timestamp", "seq")).alias("o"))
    east, north = geo.tangent_plane(F.col("latitude"), F.col("longitude"), F.col("o.latitude"), F.col("o.longitude"))
    derived = fixes.join(origin, "evidence_id").select(
        "evidence_id", F.lit("derived").alias("source"), "seq", micros(F.col("timestamp")).alias("at_us"), east.alias("x_m"), north.alias("y_m"), (F.col("altitude_m") - F.col("o.altitude_m")).alias("z_m"),
    )
    return own.unionByName(derived)


def steps(rows: DataFrame) -> DataFrame:
    """``(evidence_id, at_us, speed_mm, step_mm, acceleration_mm, climb_mm)`` of :func:`samples`,
    in whole thousandths: the length of the step from the sample before, and the change of
    velocity and height over it; zero at the start of a chunk."""
    d = lambda c: F.col(c) - F.col(f"prev.{c}")
    dt = d("timestamp")
    length = lambda xs: F.sqrt(xs[0] * xs[0] + xs[1] * xs[1] + xs[2] * xs[2])
    whole = lambda c: F.floor(c * 1000.0 + 0.5).cast("bigint")
    zero = F.lit(0).cast("bigint")
    return rows.select(
        "evidence_id", "at_us", whole(length([F.col(v) for v in VELOCITIES])).alias("speed_mm"), whole(length([d(a) for a in AXES])).alias("step_mm"),
        F.coalesce(whole(length([d(v) / dt for v in VELOCITIES])), zero).alias("acceleration_mm"), F.coalesce(whole(d("z_m") / dt), zero).alias("climb_mm"),
    )


def exact_quantiles(rows: DataFrame, keys: list[str], values: list[str], shares: dict[str, float]) -> DataFrame:
    """``(keys, field, count, least, greatest, total, <share>)`` of whole-number columns, nulls
    left out, with exact quantiles between ranks. Values are counted first, so that no group
    gathers its rows; a group's counts pass in order."""
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(v).alias("field"), F.col(v).alias("value")) for v in values])).alias("r")).select(*keys, "r.*").where("value is not null")
    counts = long.groupBy(*keys, "field", "value").agg(F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy(*keys, "field")
    counts = counts.withColumns({"upto": F.sum("n").over(of.orderBy("value")), "all": F.sum("n").over(of)})

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") > rank, F.col("value"))).cast("double")

    out = []
    for name, share in shares.items():
        place = (F.col("all") - 1) * share
        low, high = at(F.floor(place)), at(F.ceil(place))
        out.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return counts.groupBy(*keys, "field").agg(F.first("all").alias("count"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.sum(F.col("value") * F.col("n")).alias("total"), *out)
